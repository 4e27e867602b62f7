"""Alignment of two tokenizers' tokens by interval coalescing.

Both tokenizers cut the same bytes. All tokens of both, sorted by start, with the running maximum of their ends: where
a start reaches the maximum, a group of tokens ends and the next begins. Tokens of a group are linked. How many
documents hold an id pair linked is counted over the corpus and brought back to the documents.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weirflow.llm import packing
from weirflow.llm.common import Memory, small_batches, staged, texts_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Text that makes a chunk: its documents share one list of id pairs. A single longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4_096
#: Text of a chunk whose tokens are held at a time: they take up to a hundred times as much.
PART_BYTES = 256 << 10
#: Link rows that are made at a time.
SLAB = 2_000_000
_MARK = "▁"
_UNITS = re.compile(" +[^ ]*+")
_BITS = 16


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@functools.cache
def _a_bytes(path: str) -> list[bytes]:
    signs = _byte_of_sign()
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    entries = {i: bytes(map(signs.__getitem__, entry)) for entry, i in found["model"]["vocab"].items()}
    for added in found.get("added_tokens", []):
        entries[added["id"]] = added["content"].encode()
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def _b_bytes(path: str) -> list[bytes]:
    model = _pieces(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)]


class PieceEncoder:
    """Piece ids of texts; no piece goes over the space before a word, so each distinct word is encoded once and remembered."""

    def __init__(self, path: str) -> None:
        self.model, self.written, self.memory = _pieces(path), _b_bytes(path), Memory()

    def _learn(self, units: list[str]) -> Iterator[bytes | None]:
        """The packed ids of each unit; None for one that they don't spell."""
        alone = self.model.piece_to_id(_MARK)
        for unit, ids in zip(units, self.model.encode([unit[1:] for unit in units], num_threads=1)):
            ids = ids if len(unit) > 1 else [alone]
            yield array.array("i", ids).tobytes() if b"".join(map(self.written.__getitem__, ids)) == unit.encode() else None

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each space + text, which are those that the model gives for the text itself; None where they don't spell it."""
        cut = [_UNITS.findall(" " + text) if text else [] for text in texts]
        get = self.memory.recall(set().union(*cut), self._learn).__getitem__
        found = [list(map(get, units)) for units in cut]
        return [None if None in ids else np.frombuffer(b"".join(ids), np.int32).astype(np.int64) for ids in found]


class Aligned:
    """The tokens of many texts side by side: per token its text and its group, per group its texts' numbers."""

    def __init__(self, sides: list[list[np.ndarray]], lengths: list[np.ndarray]) -> None:
        self.ids = [np.concatenate([np.zeros(0, np.int64), *side]) for side in sides]
        self.texts = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in sides]
        widths = [table[ids] for table, ids in zip(lengths, self.ids)]
        ends = np.concatenate([np.cumsum(w) for w in widths])
        starts = ends - np.concatenate(widths)
        order = np.lexsort((ends, starts))
        reach = np.maximum.accumulate(ends[order]) if len(order) else ends
        breaks = np.r_[True, starts[order][1:] >= reach[:-1]][: len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        cut = len(self.ids[0])
        self.groups = [group[:cut], group[cut:]]
        self.count = int(group.max()) + 1 if len(group) else 0
        self.group_text = np.zeros(self.count, np.int64)
        self.group_text[self.groups[0]] = self.texts[0]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): the distinct id pairs of each text and how many linked occurrences each has, by text and pair.

        A group's tokens are counted by id before they are paired, and pairs are made SLAB at a time.
        """
        distinct = [np.unique((g << _BITS) | i, return_counts=True) for g, i in zip(self.groups, self.ids)]
        (a, a_times), (b, b_times) = distinct
        per_group = np.bincount(b >> _BITS, minlength=self.count)
        first = np.cumsum(per_group) - per_group
        partners = per_group[a >> _BITS]
        upto = np.cumsum(partners)
        parts, start = [], 0
        while start < len(a):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLAB, side="right")))
            many = partners[start:end]
            left = np.repeat(np.arange(start, end), many)
            right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + first[a[left] >> _BITS]
            key = (self.group_text[a[left] >> _BITS] << 2 * _BITS) | ((a[left] & 0xFFFF) << _BITS) | (b[right] & 0xFFFF)
            parts.append(_summed(key, a_times[left] * b_times[right]))
            start = end
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        key, times = parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts)))
        return key >> 2 * _BITS, key & 0xFFFFFFFF, times


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(times, first) if len(first) else times


class Aligner:
    """Encodes texts with both tokenizers and groups their tokens."""

    def __init__(self, tokenizer: str, ranks: str, model: str) -> None:
        self.tokenizer, self.ranks = tokenizer, ranks
        self.lengths = [np.array([len(x) for x in side]) for side in (_a_bytes(tokenizer), _b_bytes(model))]
        self.pieces = PieceEncoder(model)

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or that the tokens of either side don't spell, have no tokens."""
        second = self.pieces.encode(texts)
        first = [np.frombuffer(x, "<u4").astype(np.int64) for x in packing.encode([" " + t if t and ids is not None else "" for t, ids in zip(texts, second)], self.tokenizer, self.ranks)]
        for place, ids in enumerate(first):
            # byte-level tokens spell what they were made of, so their lengths tell whether any of it is missing
            if second[place] is None or self.lengths[0][ids].sum() != self.lengths[1][second[place]].sum():
                first[place] = second[place] = np.zeros(0, np.int64)
        return Aligned([first, second], self.lengths)


@functools.cache
def _spellings() -> list[str]:
    """What is written for an id: on side a, with more to come or last, and on side b."""
    return [f"{n}{sign}" for last in ("|", ";") for n in range(1 << _BITS) for sign in (",", last)]


def written_groups(found: Aligned, count: int) -> list[str]:
    """Each text's groups as a1,a2|b1;a3|b2,b3."""
    place, side = np.concatenate(found.groups), np.repeat([0, 1], [len(g) for g in found.groups])
    last = np.concatenate([np.r_[g[1:] != g[:-1], True][: len(g)] for g in found.groups])
    order = np.lexsort((side, place))
    codes = ((side << _BITS + 1) | 2 * np.concatenate(found.ids) | last)[order]
    bounds = np.searchsorted(np.concatenate(found.texts)[order], np.arange(count + 1))
    spelled = _spellings().__getitem__
    return ["".join(map(spelled, codes[a:b].tolist()))[:-1] for a, b in zip(bounds, bounds[1:])]


_CHUNKS = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>, "
    "pairs array<long>, holders array<long>"
)


def _part(aligner: Aligner, part: pa.RecordBatch) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of both sides and groups per text, the digests of the groups, and the links by text."""
    found, count = aligner.align(texts_of(part, "text")), part.num_rows
    sizes = [np.bincount(t, minlength=count) for t in (*found.texts, found.group_text)]
    return sizes, [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written_groups(found, count)], found.links()


def _chunk_batches(tokenizer: str, ranks: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer, ranks, model)
        chunk = TaskContext.get().partitionId() << 32
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in _CHUNKS.split(", "))])
        for batch in small_batches(batches, CHUNK_ROWS, CHUNK_BYTES):
            count, parts = batch.num_rows, [_part(aligner, part) for part in small_batches([batch], CHUNK_ROWS, PART_BYTES)]
            sizes, digests, links = zip(*parts)
            before = np.cumsum([0, *map(len, digests)])
            text_of, pair, times = map(np.concatenate, zip(*((text + n, *rest) for n, (text, *rest) in zip(before, links))))
            pairs, places, holders = np.unique(pair, return_inverse=True, return_counts=True)
            bounds = np.searchsorted(text_of, np.arange(count + 1))
            columns = {
                "chunk": pa.array(np.full(count, chunk)),
                "doc_id": batch.column("doc_id"),
                **{name: pa.array(size) for name, size in zip(("n_a", "n_b", "n_groups"), map(np.concatenate, zip(*sizes)))},
                "n_links": pa.array(np.add.reduceat(np.r_[times, 0], bounds[:-1]) * (bounds[1:] > bounds[:-1])),
                "groups_sha256": pa.array(itertools.chain(*digests), pa.string()),
                "places": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places, pa.int32())),
                "times": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times)),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)
            whole = {"chunk": pa.array([chunk]), "pairs": pa.array([pairs], pa.list_(pa.int64())), "holders": pa.array([holders], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([whole[f.name] if f.name in whole else pa.nulls(1, f.type) for f in schema], schema=schema)
            chunk += 1

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _count_chunk(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the corpus-wide counts of their pairs, which the places tell in order of pair."""
    counts = counts.sort_by("pair")
    n, best = counts["n"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
    n_best, total = [], []
    for places, times in zip(docs["places"], docs["times"]):
        at, often = places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64), times.values.to_numpy() if times.is_valid else np.zeros(0, np.int64)
        n_best.append(int((best[at] * often).sum()))
        total.append(int((n[at] * often).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64()))
    return out.append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, a, n, best over chunks(pairs, holders): documents that hold the pair, and whether no pair of its A id has more.

    The highest counts, one per A id, are as many as the tokenizer has ids, whatever the corpus: they are broadcast.
    """
    each = chunks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.*")
    counts = staged(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")).withColumn("a", F.shiftright("pair", _BITS)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(highest), "a").select("pair", "a", "n", (F.col("n") == F.col("_most")).alias("best"))


def digest(docs: DataFrame, tokenizer: str = packing.TOKENIZER, ranks: str = packing.RANKS, model: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs(doc_id, text).

    Texts are read in chunks of bounded size; a chunk's documents share one list of its distinct id pairs, so what is
    shuffled is a row per pair and chunk, not per pair and document. A null or empty text, and one that holds the
    white-space mark, has no tokens: zeros and an empty digest. Repeated rows are documents each for itself, null ids
    stay null, an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = staged(rows.mapInArrow(_chunk_batches(tokenizer, ranks, model), _CHUNKS), "chunks")
    pairs = chunks.where("pairs IS NOT NULL").select("chunk", F.explode("pairs").alias("pair"))
    counted = pairs.join(pair_counts(chunks).select("pair", "n", "best"), "pair").select(F.col("chunk").alias("_of"), "pair", "n", "best")
    mine = chunks.where("pairs IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    return mine.groupBy("chunk").cogroup(counted.groupBy("_of")).applyInArrow(_count_chunk, _RESULT)


_GROUPS = "doc_id long, groups array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>"


def _group_batches(tokenizer: str, ranks: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer, ranks, model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]))
        for batch in small_batches(batches, CHUNK_ROWS, CHUNK_BYTES // 4):
            texts = texts_of(batch, "text")
            found = aligner.align(texts)
            width = np.bincount(found.groups[0], aligner.lengths[0][found.ids[0]], found.count).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(found.count + 1)), pa.int32()), pa.array(i, pa.int32())) for g, i in zip(found.groups, found.ids)]
            bounds = np.searchsorted(found.group_text, np.arange(len(texts) + 1))
            upto = np.cumsum(width)
            before = np.r_[0, upto][bounds[:-1]]
            end = upto - before[found.group_text]
            each = pa.StructArray.from_arrays([pa.array(end - width), pa.array(end), *lists], ["start", "end", "a_ids", "b_ids"])
            groups = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), groups], ["doc_id", "groups"])

    return run


def groups(docs: DataFrame, tokenizer: str = packing.TOKENIZER, ranks: str = packing.RANKS, model: str = PIECES) -> DataFrame:
    """(doc_id, groups) of docs(doc_id, text): each group's byte range in space + text and its ids on both sides, in order.

    A text without tokens has no groups. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_group_batches(tokenizer, ranks, model), _GROUPS)
