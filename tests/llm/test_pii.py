import hashlib
import random
import re
import time

import pytest

from weirflow.llm import pii

# The base patterns exactly as stated, for brute force.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain_base(text):
    found = {}
    for kind, pattern in BASE.items():
        found[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found[kind].append(m.span())
    return found


def test_base_spans_match_the_stated_patterns():
    draw = random.Random(1)
    alphabet = "ab9 1.2@+-()%_@..0425 \n"
    pool = ["a@b.c", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "x.y@h-1.co.uk.", "@@", "1..2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        text = text[:10] + draw.choice(pool) + text[10:]
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize(
    ("kind", "shown"),
    [
        ("email", "jane.doe [at] example [dot] com"),
        ("email", "jane.doe(at)example(dot)com"),
        ("email", "jane.doe at example dot com"),
        ("email", "jane AT mail DOT example DOT org"),
        ("email", "jane{at}example{dot}com"),
        ("email", "jane＠example．com"),
        ("email", "jаne@exаmple.com"),
        ("email", "jane&#64;example.com"),
        ("email", "jane @ example . com"),
        ("email", "jane_at_example_dot_com"),
        ("email", "jane -at- example -dot- com"),
        ("email", "jane dot doe at example dot com"),
        ("email", "jane@example dot com"),
        ("phone", "+1 (4l5) 555-O123"),
        ("card", "4lll 1111 1111 llI1"),
        ("ip", "192.l68.O.1"),
        ("phone", "+1 (four one five) five five five zero one two three"),
        ("phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("phone", "+１ (４１５) ５５５ ０１２３"),
        ("card", "four one one one one one one one one one one one one one one one"),
        ("card", "4111–1111–1111–1111"),
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "192[.]168[.]0[.]1"),
        ("ip", "192․168․0․1"),
    ],
)
def test_disguises_map_back_to_the_source(kind, shown):
    text = f"é Write to: {shown}, or not."
    base, added = pii.find(text)
    assert not base[kind] or shown.startswith("j") is False or kind == "email"
    spans = base[kind] + added[kind]
    assert len(spans) == 1, (spans, added)
    a, b = spans[0]
    assert text[a:b] == shown or (shown.startswith("jаne") and text[a:b] == shown), text[a:b]
    assert shown.split()[0][:2] not in pii.redacted(text)


@pytest.mark.parametrize(
    "text",
    [
        "", "At the end, look at the dot on the map.", "one two three go", "He is at home. Dot com was a boom.", "One, two, three, four, five.",
        "Look at page 4. At 5 p.m. we meet at noon dot.", "un deux trois la la la", "look at example.com for more", "in 2O21 I had 1 of 10, ol 5",  "version 1.2.3 and 10 000 000", "Été à Nîmes – déjà vu – 12:30",
    ],
)
def test_clean_texts_have_no_spans(text):
    base, added = pii.find(text)
    assert not any(base.values()) and not any(added.values())


def test_query_rows(spark):
    rows = [(1, "mail a@b.co now +1 (555) 010-9999"), (2, None), (2, ""), (None, "x at y dot com"), (3, "z" * 200_000 + "@")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string")
    found = {(r.doc_id, r.spans): r for r in pii.detect(docs).collect()}
    one = found[(1, "email:5:11,phone:16:33")]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.n_added) == (1, 0, 0, 1, 0)
    assert one.base_sha256 == hashlib.sha256(b"email:5:11,phone:16:33").hexdigest()
    assert found[(None, "email:0:14")].n_added == 1 and found[(2, "")].n_email == 0
    assert pii.detect(docs).count() == len(rows) and pii.detect(docs.limit(0)).count() == 0


def test_redaction_keeps_all_else(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "x", 99), (2, None, "y", 5)], "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail [EMAIL] now" and out[1].n_chars == 16 and out[2].text is None and out[1].source == "x"


DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
GLYPHS = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "i": "і"}


def disguised(draw, kind):
    """A known identifier and a random disguise of it."""
    name = lambda: "".join(draw.choice("abcdeoprstxi") for _ in range(draw.randint(3, 8)))
    if kind == "email":
        labels = [name() for _ in range(draw.randint(1, 2))] + [draw.choice(["com", "hu", "uy", "museum", "company", "photography", "no", "is", "x" + name()])]
        local = "q" + name() + draw.choice(["", str(draw.randint(10, 99))])
        labels[:-1] = ["z" + x for x in labels[:-1]]  # no word of any language
        at = draw.choice([" at ", " AT ", "[at]", " (at) ", "{at}", " @ ", "_at_", "-at-", "&#64;", "＠"])
        dot = draw.choice([" dot ", " Dot ", "[dot]", " (dot) ", "[.]", "_dot_", "-dot-", *(["．"] if at in ("&#64;", "＠") else [])])
        shown = local + at + dot.join(labels)
        if "at" not in at.lower() and at.strip() and draw.random() < 0.5:
            shown = "".join(GLYPHS.get(c, c) for c in local) + at + dot.join(labels)
        return shown
    if kind == "ip":
        parts = [draw.randint(0, 255) for _ in range(4)]
        spell = lambda n: " ".join(DIGIT_WORDS[int(d)] for d in str(n))
        say = draw.choice([str, spell, lambda n: draw.choice([str, spell])(n)])
        return draw.choice([" dot ", " DOT "]).join(map(say, parts)) if say is not str else draw.choice(["[.]", " dot ", "(dot)", "․", " [dot] "]).join(map(str, parts))
    if kind == "phone":
        digits = [draw.randint(1, 9), *(draw.randint(0, 9) for _ in range(draw.randint(9, 12)))]
        words = [DIGIT_WORDS[d] if draw.random() < 0.7 else str(d) for d in digits]
        words[0], words[-1] = DIGIT_WORDS[digits[0]], DIGIT_WORDS[digits[-1]]
        return draw.choice(["+", "plus "]) + draw.choice([" ", "-", ", "]).join(words)
    digits = [draw.randint(1, 9), *(draw.randint(0, 9) for _ in range(14))]
    digits.append(next(d for d in range(10) if luhn("".join(map(str, digits)) + str(d))))
    groups = ["".join(map(str, digits[i : i + 4])) for i in range(0, 16, 4)]
    way = draw.randint(0, 2)
    if way == 0:
        return " ".join(DIGIT_WORDS[d] for d in digits)
    if way == 1:  # one digit of all is a word
        at = draw.randrange(16)
        return " ".join(DIGIT_WORDS[d] if i == at else str(d) for i, d in enumerate(digits))
    return draw.choice(["–", "‑", "−"]).join(groups)


@pytest.mark.parametrize("kind", pii.KINDS)
def test_a_random_disguise_returns_its_source_span(kind):
    draw = random.Random(11)
    for _ in range(400):
        shown = disguised(draw, kind)
        before, after = draw.choice(["", "Write to: ", "été (", "Ok. ", "x; "]), draw.choice(["", "; thanks", ")", " / end", "!"])
        text = before + shown + after
        base, added = pii.find(text)
        assert (len(before), len(before) + len(shown)) in base[kind] + added[kind], (text, base, added)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("jane@example.co dot uk now", [(0, 15), (0, 22)]),
        ("jane@example.com. It is", [(0, 16)]), ("write—jane@example.com", [(6, 22)]), ("we arrive at this point in time", []), ("at one point it was", []),
        ("jane@example. then more", []), ("jane at example dot com dot I think", [(0, 23)]), ("sam7 at host dot museum", [(0, 23)]), ("jane arroba ejemplo punto es", [(0, 28)]),
        ("jane at example dot hu", [(0, 22)]), ("jane at example dot museum", [(0, 26)]), ("jane at example dot company", [(0, 27)]), ("jane arroba ejemplo punto uy", [(0, 28)]),
        ("jane at example dot it", [(0, 22)]), ("look at this dot it is fine", []), ("look at red dot number five", []), ("it was at each dot company wide", []), ("jane at the dot company", []),
        ("jane at example dot hu dot then", [(0, 22)]), ("jane @ example.hu", [(0, 17)]), ("jane at me dot com", [(0, 18)]), ("we met @ noon.then home", []),
    ],
)
def test_addresses_end_where_they_should(text, spans):
    base, added = pii.find(text)
    assert sorted(base["email"] + added["email"]) == spans


def test_number_words_behind_a_phone_number():
    assert not pii.find("call +1 (555) 010-9999 one of us")[1]["phone"]
    assert pii.find("call +1 (555) 010- nine nine nine nine now")[1]["phone"] == [(5, 38)]


@pytest.mark.parametrize(
    "part", ["1 ", "a dot ", " ", "one ", "x at ", "a@", "a @ ", "[", "( ", "[ at", "a-dot-", "a. ", "1 dot ", "O", "+", "&#64;", "a at b dot ", "1.", "é one 1 ", "plus "],
)
def test_time_is_linear_in_the_text(part):
    def seconds(size):
        text = part * (size // len(part)) + "x one two [dot"
        began = time.process_time()
        pii.redacted(text)
        return time.process_time() - began

    seconds(20_000)
    small, large = min(seconds(200_000) for _ in range(2)), seconds(1_000_000)
    assert large < 5 and large < 12 * small + 0.2, (small, large)
