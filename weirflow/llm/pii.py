"""Personal data in texts, plain and disguised, with offsets into the source.

Plain identifiers are found by the base patterns on the source itself. For disguised ones, transducers rewrite the
text - homoglyphs and width variants to ASCII, spelled digits to digits, at/dot disguises to their signs - and keep,
for each character that they write, the span of source characters that it came from. The base patterns then run on
what was written, and each span found maps back to the source.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import small_batches, texts_of
from weirflow.llm.spotsigs import ANCHORS

KINDS = ("email", "ip", "card", "phone")

# Leftmost matches of each pattern, in time linear in the text: a run of digits is entered at its start only.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _HOST.match(text, at) if start < at else None
        floor = match.end() if match else at + 1
        if match:
            found.append((start, floor))
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind on the text as it is."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        spans["email"] = _emails(text)
    if _DIGIT.search(text):
        spans["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for match in _CARD.finditer(text):
            if match.end() - match.start() >= 16:
                digits = _NO_DIGIT.sub("", match[0])
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    spans["card"].append(match.span())
        if "+" in text:
            spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return spans


# ---- fixed values: characters that look like ASCII ones, beside those that Unicode's own tables map ----
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ᴏ": "o", "ⅼ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "·": ".", "•": ".",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORDS = ("at", "arroba", "arobase", "klammeraffe", "ät")
_DOT_WORDS = ("dot", "punto", "point", "punkt", "period")
#: Dot words that go with an at word of their language; with others only the plain labels below end a host.
_PAIRED = {"at": ("dot", "punkt"), "ät": ("dot", "punkt"), "klammeraffe": ("dot", "punkt"), "arroba": ("dot", "punto"), "arobase": ("dot", "point")}
_PLAIN_LABELS = ("com", "org", "net", "edu", "gov", "biz", "info", "io", "fr", "uk", "ca", "pl", "nl", "dk", "cz")
_FIGURES = str.maketrans("OolI", "0011")
_PLUS_WORDS = ("plus", "más", "mas")
#: Last labels that are common words too, and those that may stand behind a dot with a space beside it.
_WORDY_TOPS = ("me", "us", "it", "at", "be", "in", "is", "my", "so", "to", "no", "de", "es", "la", "as", "an", "am")
_SPACED_TOPS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "ai", "app", "dev", "co", "tv", "eu", "uk", "ca", "au", "nz", "ie",
    "fr", "nl", "ch", "pt", "se", "dk", "fi", "pl", "cz", "gr", "ru", "ua", "tr", "cn", "jp", "kr", "br", "mx", "ar", "cl", "za", "example",
)
#: Words that go before at in plain prose, and that follow it there; they are no names.
_BEFORE_AT = (
    "aim aimed arrive arrived arrives arriving be been begin begins ended glance glanced he here is it keep laugh laughed look looked looking looks meet met now place placed "
    "point pointed pointing remain remained rest run sat see seen set she shoot shot shout shown sit sitting smile smiled stand standing stare stared staring start started stay "
    "stayed stop stopped talk them there they throw us was we were work worked working you"
).split()
_AFTER_AT = (
    "all any both each either every first former it its last least most next night noon once one other present random same some that the these this those times various what which"
).split()
# ---- end of fixed values ----
#: Common words; a single letter may be a name.
_WORDS = frozenset(w for w in ANCHORS if len(w) > 1)


def _lookalike(char: str) -> str | None:
    """The ASCII text that a character looks like; None if it has none."""
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    plain = unicodedata.normalize("NFKC", char)
    if plain != char and plain.isascii() and plain.isprintable() and len(plain) == 1:
        return plain
    digit = unicodedata.decimal(char, None)
    return None if digit is None else str(digit)


#: All characters that are rewritten one by one, from the tables above and from Unicode's compatibility mappings.
HOMOGLYPHS = {c: plain for c in map(chr, range(0xA0, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (plain := _lookalike(c)) is not None and c not in "ªº¹²³"}


def _class(chars) -> str:
    codes, runs = sorted(map(ord, chars)), []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]"


#: Those of the basic plane, and for speed all others, of which only the table's are rewritten.
_HOMOGLYPH = re.compile(_class(c for c in HOMOGLYPHS if c <= "\uffff")[:-1] + "\U00010000-\U0001ffff]")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_ANY_AT, _ANY_DOT = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
_BRACKETED = re.compile(
    rf"{_OPEN}\s*+(?:(?P<at>{_ANY_AT}|@|a)|(?P<dot>{_ANY_DOT}|\.))\s*+{_CLOSE}\s*+|(?P<code>&#64;|&#x40;|&commat;|%40)|(?P<point>&#46;|&#x2e;|&period;|%2e)", re.I
)
_BRACKET_HINT = re.compile(r"[\[({<&%]")
_SPACED_AT = re.compile(r"@\s|\s@")
_NO_WORD = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})

# Each pattern below begins at a fixed place - a word's end, a number's start - and gives nothing back, so that a text
# is read a fixed number of times, however long its runs are.
_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"\)?(?:\s*+[-,/]\s*+|\s++)\(?")
_LABEL = r"[A-Za-z0-9_%+-]"
_AT_SITE = re.compile(rf"(?<={_LABEL})(?:\s++({_ANY_AT})\s++|\s*+@\s*+|\s*+[_-]({_ANY_AT})[_-]\s*+)(?=[A-Za-z0-9-])", re.I)
_DOT_SITE = re.compile(rf"(?<={_LABEL})(?:\s++({_ANY_DOT})\s++|\s*+[_-]({_ANY_DOT})[_-]\s*+|\s++\.\s*+|\.\s++)(?=[A-Za-z0-9-])", re.I)
_HOST_LABEL = re.compile(r"[A-Za-z0-9-]++")
_LOCAL_LABELS = re.compile(r"[A-Za-z0-9_%+.-]")
_AFTER_SPACED = re.compile(r"[A-Za-z]{2,6}+\b(?!\s*+[@(])")
_SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s++(?:{_ANY_DOT})\s++|\s*+{_OPEN}(?:{_ANY_DOT}|\.){_CLOSE}\s*+)[0-9]{{1,3}}){{3}}(?![0-9.])", re.I)


def _may_spell(text: str) -> bool:
    """Whether a spelled digit stands beside another digit word, a figure or a dot word; a site can be nowhere else."""
    words = text.lower().translate(_NO_WORD).split() if text.isascii() else _WORD.findall(text.lower())
    if _SPELLED.keys().isdisjoint(words):
        return False
    beside = lambda word: word in _SPELLED or word[:1].isdigit() or word in _DOT_WORDS
    return any(beside(words[i + d]) for i, word in enumerate(words) if word in _SPELLED for d in (-1, 1) if 0 <= i + d < len(words))


def _may_be_wordy(text: str) -> bool:
    lowered = text.lower()
    return any(word in lowered for word in _DOT_WORDS) or "@" in text and _SPACED_AT.search(text) is not None


class Normalised:
    """A text with the span of source characters behind each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.starts = text, np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1

    def rewrite(self, sites: list[tuple[int, int, str]]) -> None:
        """Put what is written in place of each (start, end), left to right, not overlapping."""
        if not sites:
            return
        text, starts, ends, at = [], [], [], 0
        for start, end, written in sites:
            text += [self.text[at:start], written]
            starts += [self.starts[at:start], np.full(len(written), self.starts[start])]
            ends += [self.ends[at:start], np.full(len(written), self.ends[end - 1])]
            at = end
        self.text = "".join(text) + self.text[at:]
        self.starts, self.ends = np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def _run_sites(text: str, run: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """What is written for a run of digit words and figures: its digits; what lies between them goes."""
    at = run[0][0]
    for first, last, written in run:
        if first > at:
            yield at, first, ""
        if text[first:last] != written:
            yield first, last, written
        at = last


def _begun(text: str, run: list[tuple[int, int, str]], before: tuple[int, int, str] | None) -> list[tuple[int, int, str]]:
    """The run with the bracket, the plus sign or the plus word in front of it."""
    start, front = run[0][0], []
    if text[start - 1 : start] == "(":
        start -= 1
        front = [(start, start + 1, "")]
    if text[start - 1 : start] == "+":
        start -= 1
        front = [(start, start + 1, "+"), *front]
    if before and before[2] in _PLUS_WORDS and before[1] < start and text[before[1] : start].isspace():
        front = [(before[0], before[1], "+"), *front]
    return [*front, *run]


def _spelled_sites(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit words, or of digit words and figures, as figures; a digit word alone only beside a dot word."""
    sites: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []
    spelled = 0
    before = in_front = last = None  # the word before this one, the one before the run, whether the run follows a dot word

    def close(following: str) -> None:
        if spelled and (len(run) > 1 or following in _DOT_WORDS or in_front and in_front[2] in _DOT_WORDS):
            sites.extend(s for s in _run_sites(text, _begun(text, run, in_front)) if s[0] < s[1])

    for match in _WORD.finditer(text):
        start, end = match.span()
        word = match[0].lower()
        digits = _SPELLED.get(word) or (word if word.isascii() and word.isdigit() else None)
        if run and (digits is None or not _GAP.fullmatch(text, run[-1][1], start)):
            close(word if text[run[-1][1] : start].isspace() else "")
            run, spelled = [], 0
        if digits is not None:
            if not run:
                in_front = before
            run.append((start, end, digits))
            spelled += word in _SPELLED
        before = (start, end, word)
    if run:
        close("")
    return sites


def _bracket_sites(text: str) -> list[tuple[int, int, str]]:
    """Signs in brackets or as codes; a dot in brackets is left to the transducer behind this one, as a dot that is said."""
    sites, at = [], 0
    for match in _BRACKETED.finditer(text):
        start = match.start()
        if match["at"] or match["dot"]:  # the white space in front belongs to it
            while start > at and text[start - 1].isspace():
                start -= 1
        at = match.end()
        sites.append((start, at, "@" if match["at"] or match["code"] else " dot " if match["dot"] else "."))
    return sites


def _word_of(match: re.Match) -> str:
    return (match[1] or match[2] or "").lower()


def _local_dots(text: str, at: int, floor: int, ending: dict[int, re.Match]) -> tuple[list[re.Match], str, bool]:
    """Dots said in the local part that ends at a place, its last word, and whether it is more than one plain word."""
    dots, marked, end = [], False, at
    while at > floor:
        while at > floor and _LOCAL_LABELS.match(text[at - 1]):
            at -= 1
            marked |= not text[at].isalpha()
        site = ending.get(at)
        if site is None or not _word_of(site) or site.start() < floor:
            break
        dots.append(site)
        at, marked = site.start(), True
    return dots, "" if marked else text[at:end].lower(), marked


def _host_labels(text: str, at: int, starting: dict[int, re.Match], starts: list[int]) -> list[tuple[str, re.Match | None]]:
    """The labels of a host from a place on, each with the dot said in front of it, None for a plain one."""
    labels: list[tuple[str, re.Match | None]] = []
    said, plain = None, False
    while match := _HOST_LABEL.match(text, at):
        end = match.end()
        place = bisect.bisect_right(starts, at)
        if place < len(starts) and starts[place] < end:  # a dot said with hyphens inside
            end = starts[place]
        labels.append((text[at:end], said))
        if text[end : end + 1] == "." and _HOST_LABEL.match(text, end + 1):
            at, said, plain = end + 1, None, True
            continue
        said = starting.get(end)
        if said is None or not _word_of(said) and (plain or "." not in said[0] or said[0][0] == "." and not _AFTER_SPACED.match(text, said.end())):
            break
        at = said.end()
    return labels


def _accepts(sign: str, labels: list[tuple[str, re.Match | None]], local: str, marked: bool) -> bool:
    """Whether host labels behind a sign (an at word, or @ with or without space) make an address.

    No list says which labels may end a host; what tells an address from prose is that none of its words is one that
    prose has there. A local part that is marked as one, by a figure or a sign, is no word.
    """
    said = [dot for _, dot in labels if dot is not None]
    last = labels[-1][0].lower()
    named = len(last) > 1 and last.isalpha() and (last not in _WORDS and last not in _AFTER_AT or last in _WORDY_TOPS)
    hosts = {x.lower() for x, _ in labels[:-1]}
    prose = not marked and (local in _BEFORE_AT or local in _WORDS) or not hosts.isdisjoint(_AFTER_AT) or last not in _SPACED_TOPS and not hosts.isdisjoint(_WORDS)
    if not said or len(labels) < 2:
        return sign == " @ " and len(labels) > 1 and named and not prose
    if any(not _word_of(dot) for dot in said):  # a dot with a space beside it: also the end of a sentence
        return last in _SPACED_TOPS or last in _WORDY_TOPS and sign == "@" and len(said) == len(labels) - 1 and not prose
    if not sign.strip(" @"):
        return True
    if any(_word_of(dot) not in _PAIRED[sign] for dot in said):
        return last in _PLAIN_LABELS
    return named and not prose


def _wordy_sites(text: str) -> list[tuple[int, int, str]]:
    """Addresses with at or dot said or spaced: from each at, the local part to its left and the host to its right.

    The words between two at signs are read twice at most, once as a host and once as a local part.
    """
    dots = list(_DOT_SITE.finditer(text))
    starting, ending, starts = {m.start(): m for m in dots}, {m.end(): m for m in dots}, [m.start() for m in dots]
    sites, floor = [], 0
    for site in _AT_SITE.finditer(text):
        if site.start() <= floor:
            continue
        labels = _host_labels(text, site.end(), starting, starts)
        sign = _word_of(site) or ("@" if site[0] == "@" else " @ ")
        local, word, marked = _local_dots(text, site.start(), floor, ending)
        while labels and not _accepts(sign, labels, word, marked):
            labels.pop()
        floor = site.end()
        if labels:
            sites += [(*m.span(), ".") for m in reversed(local)]
            if site[0] != "@":
                sites.append((*site.span(), "@"))
            sites += [(*dot.span(), ".") for _, dot in labels if dot is not None]
            floor = max([floor, *(dot.end() for _, dot in labels if dot is not None)])
    sites += [(m.start() + d.start(), m.start() + d.end(), ".") for m in _SPOKEN_IP.finditer(text) for d in _NO_DIGIT.finditer(m[0])]
    out, at = [], 0
    for site in sorted(sites):
        if site[0] >= at:
            out.append(site)
            at = site[1]
    return out


_IN_FIGURES = re.compile(r"(?<=[0-9])[OolI]+(?=[0-9])|(?<![^\W_])[OolI]+(?=[0-9])|(?<=[0-9])[OolI]+(?![^\W_])|(?<=[0-9]\.)[OolI](?=\.[0-9OolI])")


def _figure_sites(text: str) -> list[tuple[int, int, str]]:
    """Letters that stand for 0 and 1 among figures."""
    return [(*m.span(), m[0].translate(_FIGURES)) for m in _IN_FIGURES.finditer(text)]


def _homoglyph_sites(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), HOMOGLYPHS[m[0]]) for m in _HOMOGLYPH.finditer(text) if m[0] in HOMOGLYPHS]


#: Run one after the other; a cheap test first tells whether a text can have any site.
_TRANSDUCERS = (
    (lambda text: not text.isascii() and _HOMOGLYPH.search(text), _homoglyph_sites),
    (_BRACKET_HINT.search, _bracket_sites),
    (_DIGIT.search, _figure_sites),
    (_may_spell, _spelled_sites),
    (_may_be_wordy, _wordy_sites),
)


def _goes_on(text: str, kind: str, span: tuple[int, int], known: list[tuple[int, int]]) -> bool:
    """Whether a span that holds base spans whole says more of the same identifier: not a dash or bullet beside it, nor one number word."""
    beyond = f"{text[span[0] : known[0][0]]} {text[known[-1][1] : span[1]]}"
    return not any(HOMOGLYPHS.get(c, "x") in "-._+%" for c in beyond) and len(_WORD.findall(beyond)) > (kind != "email")


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of disguised identifiers: those that touch no base span of their kind, or that hold one whole and go on."""
    normal = None
    for may_have, sites_of in _TRANSDUCERS:
        now = normal.text if normal else text
        if may_have(now) and (sites := sites_of(now)):
            normal = normal or Normalised(text)
            normal.rewrite(sites)
    if normal is None:
        return {kind: [] for kind in KINDS}
    added = {}
    for kind, spans in base_spans(normal.text).items():
        known = base[kind]
        new, at = [], 0
        for span in (normal.source(*s) for s in spans):
            while at < len(known) and known[at][1] <= span[0]:
                at += 1
            touched = known[at : bisect.bisect_left(known, (span[1], 0))]
            if not touched or span not in touched and all(span[0] <= a and b <= span[1] for a, b in touched) and _goes_on(text, kind, span, touched):
                new.append(span)
        added[kind] = new
    return added


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    base = base_spans(text)
    return base, added_spans(text, base)


def _told(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = []
        for text in texts_of(batch, "text"):
            base, added = find(text)
            both = {kind: base[kind] + added[kind] for kind in KINDS}
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(both), sum(map(len, added.values()))))
        columns = list(zip(*rows))
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, types)], [x.split()[0] for x in _RESULT.split(", ")])


def detect(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): counts and digest of the base spans, and all spans.

    n_email, n_ip, n_card, n_phone count base spans; n_added counts what the transducers found beside them. A null
    text is the empty text, which has no spans. Repeated rows give repeated rows; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_detect, _RESULT)


def redacted(text: str) -> str:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] in place of each identifier; of spans that overlap, the first kind's name."""
    base, added = find(text)
    spans = sorted((a, b, kind) for kind in KINDS for a, b in base[kind] + added[kind])
    if not spans:
        return text
    out, at, merged = [], 0, []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        column = [None if x is None else redacted(x) for x in batch.column("text").to_pylist()]
        arrays = [pa.array(column, batch.schema.field("text").type) if name == "text" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each identifier in text replaced by its kind, and n_chars, if there, counted again.

    A null text stays null, an empty one empty. Repeated rows give repeated rows, an empty table none; all other
    columns pass as they are, whatever their names.
    """
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
