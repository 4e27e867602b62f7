"""Near-duplicates among all SpotSigs fingerprints: sets met by length partition and rare signature.

Sets that reach the threshold lie in the same or in neighbouring length partitions, and share one of the rarest
signatures of each: as many as a set may lack, and one more. A set is therefore listed under its rarest signatures,
in its own partition and in the next one. What meets in a list is pruned by lengths and by a bitmap of 256 bits that
can't differ in more places than the sets do; what is left is compared through pruned Jaccard, with the whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import small_batches, staged, texts_of
from weirflow.llm.components import connected_components
from weirflow.llm.spotsigs import THRESHOLD, _lowest, length_partition, pruned_likeness, signatures

#: How often signatures occur is counted by their first bits: so many counts, which decide only the order of rarity.
COUNTS = 1 << 18
BITMAP = 256
#: Lists up to this size give every pair that pruning leaves; larger ones first a spanning forest of them.
SMALL_LIST = 16
#: Lists above this size are cut into blocks, and each pair of blocks is a list of its own.
HOT_LIST = 8_000
#: What meets by a set that very many share is dealt over so many keys.
SPREAD = 128
_EPS = 1e-9
_MET = "key long, set_id binary, n int, own boolean, bitmap binary, root binary"
_FOUND = "kind int, other binary, " + _MET
_PAIR, _OPEN, _HOT = range(3)


def _fingerprinted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in small_batches(batches):
                found = [signatures(text) for text in texts_of(batch, "text")]
                raw = [x.tobytes() for x in found]
                partitions = pa.array([length_partition(len(x), threshold) for x in found], pa.int32())
                columns = [batch.column("doc_id"), partitions, pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length_partition", "set_id", "signatures"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTS, np.int64)
    for batch in small_batches(batches, column="signatures"):
        total += np.bincount(_place(np.frombuffer(b"".join(batch.column("signatures").to_pylist()), "<u4")), minlength=COUNTS)
    places = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total[places])], ["place", "n"])


def _place(found: np.ndarray) -> np.ndarray:
    return found >> np.uint32(32 - (COUNTS.bit_length() - 1))


def _rarity(sets: DataFrame) -> np.ndarray:
    """How often each place's signatures occur in all sets; COUNTS numbers, whatever the sets are."""
    found = sets.select("signatures").mapInArrow(_counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTS, np.int64)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    return counts


def _lists(counts, threshold: float):
    """The rows under which each set is listed. Sets too small to be like any other set have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column="signatures"):
            keys, ids, sizes, owns, maps = [], [], [], [], []
            for set_id, raw in zip(batch.column("set_id").to_pylist(), batch.column("signatures").to_pylist()):
                found = np.frombuffer(raw, "<u4")
                n = len(found)
                if n < threshold * (n + 1) - _EPS:
                    continue
                rare = found[np.argsort(counts.value[_place(found)], kind="stable")[: n - math.ceil(threshold * n - _EPS) + 1]].astype(np.int64)
                bitmap = np.packbits(np.bincount(found % np.uint32(BITMAP), minlength=BITMAP) & 1).tobytes()
                partition = length_partition(n, threshold)
                met = [partition, partition + 1] if n >= threshold * _lowest(partition + 1, threshold) - _EPS else [partition]
                for slot in met:
                    keys.append(rare | slot << 32)
                    ids += [set_id] * len(rare)
                    sizes += [n] * len(rare)
                    owns += [slot == partition] * len(rare)
                    maps += [bitmap] * len(rare)
            if keys:
                columns = [pa.array(np.concatenate(keys)), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(owns), pa.array(maps, pa.binary()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _MET.split(", ")])

    return run


class _List:
    """Rows of whole lists, sorted by key, in columns."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, threshold: float) -> None:
        self.rows, self.threshold = batch, threshold
        self.keys = batch.column("key").to_numpy()
        self.sizes = batch.column("n").to_numpy().astype(np.int64)
        self.own = batch.column("own").to_numpy(zero_copy_only=False)
        self.maps = np.frombuffer(b"".join(batch.column("bitmap").to_pylist()), np.uint64).reshape(len(self.keys), BITMAP // 64)
        self.ids, self.roots = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("set_id", "root"))

    def may_reach(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Whether lengths and bitmaps allow the threshold; two guests of a list meet in their own partition."""
        both = self.sizes[a] + self.sizes[b]
        differ = np.bitwise_count(self.maps[a] ^ self.maps[b]).sum(axis=-1)
        near = differ <= (1 - self.threshold) / (1 + self.threshold) * both + _EPS
        near &= np.minimum(self.sizes[a], self.sizes[b]) >= self.threshold * np.maximum(self.sizes[a], self.sizes[b]) - _EPS
        return near & (self.own[a] | self.own[b]) & (self.roots[a] != self.roots[b])

    def forest(self, members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """A spanning forest of what pruning leaves: each found member with those found from it."""
        rest = members
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop(0)
                hit = self.may_reach(one, rest)
                if hit.any():
                    yield one, rest[hit]
                    queue.extend(rest[hit])
                    rest = rest[~hit]

    def every(self, members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i, one in enumerate(members[:-1], 1):
            hit = self.may_reach(one, members[i:])
            if hit.any():
                yield one, members[i:][hit]

    def found(self, first: bool) -> Iterator[pa.RecordBatch]:
        """Pairs; the first time, large lists give a forest, and the members of its larger trees as open rows."""
        starts = np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1]]) if len(self.keys) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[starts, len(self.keys)])
        for start, length in zip(starts[lengths > SMALL_LIST].tolist(), lengths[lengths > SMALL_LIST].tolist()):
            members, in_trees = np.arange(start, start + length), []
            for one, others in self.forest(members) if first else self.every(members):
                yield self._told(_PAIR, np.full(len(others), one), others)
                in_trees += [[one], others]
            if first and in_trees and len(open_rows := np.unique(np.concatenate(in_trees))) > 2:
                yield self._told(_OPEN, open_rows)
        small = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SMALL_LIST), lengths))
        keys = self.keys[small]
        for lag in range(1, SMALL_LIST):
            same = np.flatnonzero(keys[lag:] == keys[:-lag])
            if not len(same):
                break
            a, b = small[same], small[same + lag]
            near = self.may_reach(a, b)
            if near.any():
                yield self._told(_PAIR, a[near], b[near])

    def _told(self, kind: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
        rows = self.rows.take(pa.array(a))
        other = pa.array(self.ids[b].tolist(), pa.binary()) if b is not None else pa.nulls(len(a), pa.binary())
        return _rows_of(kind, rows, other)


def _rows_of(kind: int, rows: pa.RecordBatch, other: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), other, *rows.columns], [x.split()[0] for x in _FOUND.split(", ")])


def _finder(threshold: float, first: bool, hot_list: int | None):
    """Reads rows sorted by key, and holds one list at a time beside a batch; the rows of a list beyond hot_list are given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks().to_batches()[0]
            keys, held = rows.column("key").to_numpy(), None
            if hot_key is not None:
                end = int(np.searchsorted(keys, hot_key, side="right"))
                if end:
                    yield _rows_of(_HOT, rows.slice(0, end), pa.nulls(end, pa.binary()))
                rows, keys = rows.slice(end), keys[end:]
                if not len(keys):
                    continue
                hot_key = None
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from _List(rows.slice(0, cut), threshold).found(first)
            held = rows.slice(cut)
            if hot_list is not None and held.num_rows > hot_list:
                hot_key = int(keys[-1])
                yield _rows_of(_HOT, held, pa.nulls(held.num_rows, pa.binary()))
                held = None
        if held is not None:
            yield from _List(held, threshold).found(first)

    return run


def _candidates(rows: DataFrame, threshold: float, first: bool, hot_list: int) -> DataFrame:
    """Pairs and open rows of all lists; what a task gave back as hot goes through pairs of blocks."""
    sort = lambda df: df.repartition("key").sortWithinPartitions("key", "set_id")
    found = staged(sort(rows).mapInArrow(_finder(threshold, first, hot_list), _FOUND), "spotsigs-met")
    hot = found.where(F.col("kind") == _HOT).drop("kind", "other")
    if hot.isEmpty():
        return found
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / hot_list).cast("int").alias("_blocks"))
    mine = F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int")
    each = hot.join(blocks, "key").withColumn("_own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = each.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other", "_blocks")
    return found.unionByName(staged(sort(paired).mapInArrow(_finder(threshold, first, None), _FOUND), "spotsigs-met"))


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column="sa"):
            sides = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            keep = [pruned_likeness(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), threshold) is not None for a, b in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs that reach the threshold. A set with very many partners is dealt over SPREAD keys."""
    ends = (F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b"))
    pairs = found.where(F.col("kind") == _PAIR).select(*ends).distinct()
    for side, other, name in (("a", "b", "sa"), ("b", "a", "sb")):
        pairs = pairs.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(SPREAD)).cast("int"))
        wanted = pairs.select(side, "_part").distinct().join(sets.select(F.col("set_id").alias(side), F.col("signatures").alias(name)), side)
        pairs = pairs.join(wanted, [side, "_part"]).drop("_part")
    return staged(pairs.mapInArrow(_verifier(threshold), "a binary, b binary"), "spotsigs-links")


def links(sets: DataFrame, threshold: float = THRESHOLD, hot_list: int = HOT_LIST) -> DataFrame:
    """(a, b) pairs of set_ids whose sets reach the threshold and that join all that are linked.

    sets(set_id, signatures) has each set once. Large lists are asked twice: first for a forest that would span them if
    all that pruning leaves were alike, then for all pairs whose ends the first links haven't joined. So a large group
    of near copies gives few pairs, and no component is lost.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_rarity(sets))  # COUNTS numbers, 2 MB
    listed = sets.mapInArrow(_lists(counts, threshold), _MET)
    met = _candidates(listed, threshold, True, hot_list)
    linked = _verified(met, sets, threshold)
    left = met.where(F.col("kind") == _OPEN).drop("kind", "other", "root")
    if left.isEmpty():
        return linked
    roots = connected_components(linked).select(F.col("node").alias("set_id"), "root")
    again = left.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    undecided = again.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most")
    more = _candidates(again.join(undecided, "key", "left_semi").select(*[x.split()[0] for x in _MET.split(", ")]), threshold, False, hot_list)
    return functools.reduce(DataFrame.unionByName, [linked, _verified(more, sets, threshold)])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hot_list: int = HOT_LIST) -> DataFrame:
    """(doc_id, n_signatures, length_partition, class_id) for each row of docs(doc_id, text).

    Texts are linked where the Jaccard likeness of their signature sets reaches the threshold, above 0 and below 1;
    class_id is the smallest doc_id that is reachable, itself included. Equal sets are one set from the start. A null
    text is the empty text; texts without a whole chain have a set of one, so they are like their equals only. Rows
    without id have a row each; a class of such rows only has a null class_id. An empty table gives no rows; other
    columns aren't read.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.mapInArrow(_fingerprinted(threshold), "doc_id long, length_partition int, set_id binary, signatures binary")
    # the part is written with the row, so it stays the same when a task is repeated
    rows = staged(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")), "spotsigs-rows")
    parts = rows.groupBy("set_id", "part").agg(F.min("doc_id").alias("least"), F.first("signatures").alias("signatures"))
    sets = parts.groupBy("set_id").agg(F.min("least").alias("least"), F.first("signatures").alias("signatures"), F.collect_list("part").alias("parts"))
    sets = staged(sets, "spotsigs-sets")
    roots = connected_components(links(sets.select("set_id", "signatures"), threshold, hot_list)).withColumnRenamed("node", "set_id")
    of_set = sets.select("set_id", "least", "parts").join(roots, "set_id", "left")
    linked = of_set.where("root is not null")
    classes = linked.join(linked.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("set_id", "parts", "class_id")
    alone = of_set.where("root is null").select("set_id", "parts", F.col("least").alias("class_id"))
    named = classes.unionByName(alone).select("set_id", F.explode("parts").alias("part"), "class_id")
    n = (F.octet_length("signatures") / 4).cast("long").alias("n_signatures")
    return rows.join(named, ["set_id", "part"]).select("doc_id", n, "length_partition", "class_id")
