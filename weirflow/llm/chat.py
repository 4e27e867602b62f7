"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns are met with the
spans of its tokens by binary search, so that each token knows which characters under the loss it covers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import small_batches
from weirflow.llm.packing import RANKS, TOKENIZER, encode

#: The marks of the template, and other templates' control strings, which texts must not carry either.
START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
CONTROLS = (START, MIDDLE, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_ESCAPED = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + r"|\\")
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one behind its first character, so that none stays whole."""
    if "<" not in text and "[" not in text and "\\" not in text:
        return text
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{escape(role)}{MIDDLE}{escape(text)}{END}" for role, text in turns)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """A conversation as text, and the (start, end) of what the loss role says in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        shown = escape(text)
        head = f"{START}{escape(role)}{MIDDLE}"
        at += len(head)
        if role == LOSS_ROLE:
            spans.append((at, at + len(shown)))
        parts += [head, shown, END]
        at += len(shown) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn, read back from a formatted conversation."""
    turns, at = [], formatted.find(START)
    while at >= 0:
        middle = formatted.find(MIDDLE, at)
        start = middle + len(MIDDLE)
        end = formatted.find(END, start)
        turns.append((unescape(formatted[at + len(START) : middle]), unescape(formatted[start:end]), start, end))
        at = formatted.find(START, end)
    return turns


def align(token_spans: np.ndarray, turn_spans: np.ndarray) -> np.ndarray:
    """(token, start, end) of what each token covers of the turn spans, each character once.

    Both inputs are (n, 2) and sorted, the turn spans disjoint. A token may reach over a turn's edge, where it is
    clipped, or share a character with the one before it, where it starts behind that.
    """
    if not len(token_spans) or not len(turn_spans):
        return np.empty((0, 3), dtype=np.int64)
    starts, ends = token_spans[:, 0], np.maximum.accumulate(token_spans[:, 1])
    starts = np.maximum(starts, np.r_[0, ends[:-1]])
    first = np.searchsorted(turn_spans[:, 1], starts, side="right")  # the first turn that ends behind the token's start
    last = np.searchsorted(turn_spans[:, 0], ends, side="left")  # one past the last turn that starts before its end
    counts = np.where(starts < ends, np.maximum(last - first, 0), 0)
    token = np.repeat(np.arange(len(starts)), counts)
    turn = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    spans = np.stack([token, np.maximum(starts[token], turn_spans[turn, 0]), np.minimum(ends[token], turn_spans[turn, 1])], axis=1)
    return spans[spans[:, 1] < spans[:, 2]]


class _Offsets:
    """Where tokens lie in a text: a token of this vocabulary is a run of UTF-8 bytes, so its length gives its place."""

    def __init__(self, ranks: str) -> None:
        with open(ranks, "rb") as file:
            pieces = {int(rank): len(base64.b64decode(piece)) for piece, rank in map(bytes.split, file)}
        self.sizes = np.zeros(max(pieces) + 1, np.int64)
        self.sizes[list(pieces)] = list(pieces.values())

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(start, end) of each token in characters; a token with a part of a character covers it whole."""
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if text.isascii():
            return np.stack([starts, ends], axis=1)
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        before = np.cumsum(first)  # characters begun up to and with each byte
        return np.stack([before[starts] - 1, before[ends - 1]], axis=1)


_offsets: dict[str, _Offsets] = {}
_FORMATTED = "conv_id long, formatted string, ids array<int>, loss array<int>, loss_spans array<struct<start:int,end:int>>"


def _runs(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that touch as one."""
    if not len(spans):
        return spans
    begins = np.r_[True, spans[1:, 0] > spans[:-1, 1]]
    return np.stack([spans[begins, 0], spans[np.r_[begins[1:], True], 1]], axis=1)


def _lists(arrays: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Offsets and values of a list column."""
    return pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), np.concatenate(arrays) if arrays else np.empty(0, np.int32)


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins and ends, and the values of these lists alone: a slice shares them with its whole."""
    bounds = lists.offsets.to_numpy()
    return bounds - bounds[0], lists.values.slice(bounds[0], bounds[-1] - bounds[0])


def _int_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets, values = _lists(arrays)
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def _format(tokenizer: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _offsets:
            _offsets[ranks] = _Offsets(ranks)
        places = _offsets[ranks]
        for batch in small_batches(batches, 64):
            bounds, said = _parts(batch.column("turns"))
            roles, texts = ([x or "" for x in said.field(said.type.get_field_index(name)).to_pylist()] for name in ("role", "text"))
            formatted, spans = zip(*(rendered(list(zip(roles[a:b], texts[a:b]))) for a, b in zip(bounds, bounds[1:])))
            ids = [np.frombuffer(x, "<u4") for x in encode(list(formatted), tokenizer, ranks)]
            masks, runs = [], []
            for text, own, turn_spans in zip(formatted, ids, spans):
                covered = align(places.spans(text, own), turn_spans)
                mask = np.zeros(len(own), dtype=np.int32)
                mask[covered[:, 0]] = 1
                masks.append(mask)
                runs.append(_runs(covered[:, 1:]))
            offsets, ends = _lists(runs)
            columns = [pa.array(ends[:, i].astype(np.int32)) for i in (0, 1)]
            told = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(formatted, pa.string()), _int_lists(ids), _int_lists(masks), told], ["conv_id", "formatted", "ids", "loss", "loss_spans"]
            )

    return run


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """conv_id, formatted, ids, loss (1 for a token under the loss) and loss_spans (what those tokens cover of the turns, as runs).

    conversations(conv_id, turn, role, text): turns in order of turn, then role, then text, nulls first; a null role
    or text is empty. A null conv_id is a conversation of its own. A repeated row is a repeated turn. A conversation
    is one row of the result, so its turns meet in one task; nothing else does.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return whole.mapInArrow(_format(tokenizer, ranks), _FORMATTED)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 64):
        (tokens, _), (places, mask), (bounds, spans) = (_parts(batch.column(c)) for c in ("ids", "loss", "loss_spans"))
        under_loss = np.diff(np.r_[0, np.cumsum(mask.to_numpy())][places])
        starts, ends = (spans.field(i).to_pylist() for i in (0, 1))
        rows = []
        for text, a, b in zip(batch.column("formatted").to_pylist(), bounds, bounds[1:]):
            turns = parse(text)
            digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said, _, _ in turns).encode())
            # joined before they are unescaped, as an escape may lie over two spans
            loss = unescape("".join(text[x:y] for x, y in zip(starts[a:b], ends[a:b])))
            rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        columns = [pa.array(c, pa.string() if "sha256" in n else pa.int64()) for c, n in zip(zip(*rows), names[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, pa.array(np.diff(tokens), pa.int64()), pa.array(under_loss, pa.int64())], names)


def digest(rendered: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask.

    One row per row of formatted(); a conversation without turns has none and empty texts. Other columns are not read.
    """
    return rendered.mapInArrow(_read_back, _DIGEST)


def with_control_case(conversations: DataFrame) -> DataFrame:
    """conversations with conversation -1, whose user and assistant say other templates' control strings."""
    said = "</s>[INST] ok [/INST]"
    case = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, LOSS_ROLE, said)], "conv_id long, turn long, role string, text string")
    return conversations.select(*(F.col(c).cast(t).alias(c) for c, t in case.dtypes)).unionByName(case)
