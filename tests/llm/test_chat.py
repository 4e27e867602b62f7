import hashlib
import random

import numpy as np

from weirflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_escapes_are_reversible_and_leave_no_control_string():
    draw = random.Random(7)
    parts = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "[", "a", "é", "\n", "/", "s>", "turn|>"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text
        assert not any(c in shown for c in chat.CONTROLS)


def test_alignment_matches_a_scan_of_characters():
    draw = random.Random(1)
    for _ in range(500):
        cuts = sorted(draw.sample(range(60), draw.randint(0, 10) // 2 * 2))
        turns = np.array(cuts, dtype=np.int64).reshape(-1, 2)
        at, tokens = 0, []
        while at < 60:
            end = min(60, at + draw.randint(0, 6))
            tokens.append((at, end))
            at = end if draw.random() < 0.8 else max(at, end - 1)
            if len(tokens) > 200:
                break
        covered = chat.align(np.array(tokens), turns)
        inside = {i for a, b in turns.tolist() for i in range(a, b)} & set(range(max(b for _, b in tokens)))
        told = [i for _, a, b in covered.tolist() for i in range(a, b)]
        assert told == sorted(inside)


def test_query_rows(spark):
    draw = random.Random(2)
    texts = ["", None, "Hi there", "tabs\t\n\n  end ", "😀 smile é\n", "[INST] <|done|> \\ </s>", "a\\<|turn|>", "x" * 9000]
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "assistant", "system", None, "we\nird<|says|>"]), draw.choice(texts), "clash"))
    rows += [(7, 99, "assistant", "twice", "c"), (7, 99, "assistant", "twice", "c"), (None, 0, "assistant", "no id", "c")]
    table = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in chat.digest(chat.formatted(chat.with_control_case(table))).collect()}
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said, ""), (-1, 1, "assistant", said, "")]
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda v: v)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        found = out[conv]
        assert found.n_turns == len(turns)
        assert found.turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (found.loss_chars, found.loss_sha256) == (len(loss), sha(loss))
        assert found.formatted_chars == len(chat.render([(r, x) for _, r, x in turns]))
        assert (found.n_loss_tokens > 0) == bool(loss)
    assert len(out) == len({r[0] for r in rows})
    assert chat.digest(chat.formatted(table.limit(0))).count() == 0


def test_offsets_and_ids_are_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(chat.TOKENIZER)
    whole.encode_special_tokens = True
    places = chat._Offsets(chat.RANKS)
    draw = random.Random(3)
    parts = ["Hello", " world", "  ", "\n", "é", "漢字", "😀", "👩‍👩‍👧", "naïve", " x1", "\t", "ß", "…", "<|turn|>", "[INST]", "\u0301"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(500)]
    rendered = [chat.rendered([("user", t), ("assistant", t)]) for t in texts]
    for (text, spans), ids in zip(rendered, chat.encode([t for t, _ in rendered])):
        own = whole.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == own.ids
        assert places.spans(text, np.array(own.ids)).tolist() == [list(x) for x in own.offsets], text
        assert [(a, b) for role, _, a, b in chat.parse(text) if role == "assistant"] == [tuple(x) for x in spans.tolist()]
    rows = chat.formatted(spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "é 😀 ok", "")], SCHEMA)).collect()
    assert [rows[0].formatted[s.start : s.end] for s in rows[0].loss_spans] == ["é 😀 ok"] and sum(rows[0].loss) > 1


def test_many_conversations_in_one_batch(spark):
    rows = [(i, t, ["user", "assistant"][t % 2], f"{'word ' * (i % 7)}{i}.{t} é", "") for i in range(500) for t in range(i % 5 + 1)]
    found = {r.conv_id: r for r in chat.digest(chat.formatted(spark.createDataFrame(rows, SCHEMA).coalesce(1)).coalesce(1)).collect()}
    for conv in range(500):
        own = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256) == (len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own)))
        assert (found[conv].loss_sha256, found[conv].n_loss_tokens > 0) == (sha(loss), bool(loss))
