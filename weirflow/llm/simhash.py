"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in four bits or fewer, one of the
three segments differs in at most one bit, so the two share that segment with this one bit blanked. Each
fingerprint is therefore indexed under the 64 keys (position, segment without the bit at the position); equal keys
meet in one bucket and are verified there. No link is lost and none is added.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from weirflow.llm.common import bytes_of, small_batches, staged, whole_row
from weirflow.llm.components import connected_components

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: First and one past the last bit of each segment: MOST_BITS // 3 is 1.
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Buckets up to this size are compared by shifts of the sorted column, larger ones by search from each member.
SMALL_BUCKET = 64
#: Buckets above this size go through another exchange under finer keys, so many times at most.
HOT_BUCKET = 20_000
LEVELS = 3
#: Copies of one fingerprint are spread over so many keys wherever rows meet by fingerprint.
SPREAD = 128


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text: 64 majority bits over XXH64 of its word shingles, 0 without words."""
    words = text.lower().split()  # of bytes: only A-Z are lowered, and only ASCII white space splits
    if len(words) < SHINGLE:
        if not words:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    step = 1 << 14  # bounds the memory that a very long text takes
    total = len(words) - SHINGLE + 1
    for start in range(0, total, step):
        part = words[start : start + step + SHINGLE - 1]
        hashes = np.array([digest(b"%b %b %b %b" % q, SEED) for q in zip(part, part[1:], part[2:], part[3:])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = np.array([fingerprint(x) for x in bytes_of(batch, "text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(found)], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) for each row of docs(doc_id, text); row_key is a hash of both, fp the signed 64 bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, row_key long, fp long")


def row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _variants(distinct: DataFrame) -> DataFrame:
    keys = []
    for low, high in SEGMENTS:
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        for bit in range(high - low):
            blank = segment.bitwiseAND(F.lit(~(1 << bit)).cast("long"))
            keys.append(blank.bitwiseOR(F.lit((low + bit) << 22).cast("long")))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


class _Forest:
    """Union-find over the fingerprints that a task has linked; an edge inside a tree need not be told again."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def joins(self, a: int, b: int) -> bool:
        a, b = self._root(a), self._root(b)
        if a == b:
            return False
        self.parent[b] = a
        return True


def _near(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS  # of a signed number it would count the absolute value's bits


def _search(members: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the members: each found member is compared with those not yet found."""
    rest = members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hit = _near(rest, one)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                queue.extend(found)
                yield from ((int(one), int(x)) for x in found)


def _links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links within the buckets of whole sorted runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    for start, size in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
        yield from _search(fps[start : start + size])
    small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
    keys, fps = keys[small], fps[small]
    for lag in range(1, SMALL_BUCKET):
        same = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(same):
            break
        same = same[_near(fps[same], fps[same + lag])]
        yield from zip(fps[same].tolist(), fps[same + lag].tolist())


def _finer(key: int, fps: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a hot bucket's members: its key mixed with each choice of level blocks out of MOST_BITS + level.

    Two linked members differ in MOST_BITS bits at most, so level blocks at least are equal and they share a key.
    """
    blocks = np.array_split(np.arange(64, dtype=np.uint64), MOST_BITS + level)
    choices = list(itertools.combinations(range(len(blocks)), level))
    plain = fps.view(np.uint64)
    keys = []
    for number, chosen in enumerate(choices):
        mask = np.uint64(sum(1 << int(bit) for block in chosen for bit in blocks[block]))
        mixed = (np.uint64(key & (1 << 64) - 1) * np.uint64(len(choices)) + np.uint64(number)) * np.uint64(0x9E3779B97F4A7C15)
        value = (plain & mask) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys.append(((mixed ^ value ^ (value >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)).view(np.int64))
    return np.concatenate(keys), np.tile(fps, len(choices))


def _linker(hot_bucket: int | None, level: int = 1):
    """Reads rows sorted by key; gives (kind 0, a, b) for a link and (kind 1, finer key, fp) for a hot bucket's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def told(found) -> Iterator[pa.RecordBatch]:
            new = [x for x in found if forest.joins(*x)]
            if new:
                a, b = np.array(new, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        def refined(key: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys, fps = _finer(key, fps, level)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys), pa.array(fps)], ["kind", "a", "b"])

        held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)
        hot_key = None
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
                if not len(keys):
                    continue
                if hot_key is not None:  # the bucket that grew too large goes on
                    end = np.searchsorted(keys, hot_key, side="right")
                    if end:
                        yield from refined(hot_key, fps[:end])
                    keys, fps = keys[end:], fps[end:]
                    if not len(keys):
                        continue
                    hot_key = None
                keys, fps = np.r_[held_keys, keys], np.r_[held, fps]
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from told(_links(keys[:cut], fps[:cut]))
                held_keys, held = keys[cut:], fps[cut:]
                if hot_bucket is not None and len(held) > hot_bucket:
                    hot_key = int(held_keys[0])
                    yield from refined(hot_key, held)
                    held_keys, held = held_keys[:0], held[:0]
            yield from told(_links(held_keys, held))

    return run


def _block_pairs(rows: DataFrame, hot_bucket: int) -> DataFrame:
    """rows(key, fp) once for each pair of blocks that theirs is in: blocks of a key have about half of hot_bucket rows."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") * 2 / hot_bucket).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("_blocks")).cast("int")
    each = rows.join(blocks, "key").select("key", "fp", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return each.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "fp")


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b) pairs of fingerprints that differ in at most four bits and join all that are linked.

    distinct(fp) has each fingerprint once. Every component of the link graph is spanned; links inside a component
    that other links already imply are left out, so large groups do not give all their pairs. A bucket of more than
    hot_bucket members is not held by one task: its rows go on, under finer keys, to another exchange, up to LEVELS
    times, each of which only runs if there are such rows. What is hot even then is cut into blocks by hash, and each
    pair of blocks is a bucket of its own, so no task holds more than two blocks.
    """
    sort = lambda df: df.repartition("key").sortWithinPartitions("key", "fp")
    rows, found = _variants(distinct), []
    for level in range(1, LEVELS + 1):
        done = staged(sort(rows).mapInArrow(_linker(hot_bucket, level), "kind int, a long, b long"), "simhash-links")
        found.append(done)
        hot = done.where("kind = 1")
        if hot.isEmpty():
            break
        rows = hot.select(F.col("a").alias("key"), F.col("b").alias("fp"))
    else:
        found.append(sort(_block_pairs(rows, hot_bucket)).mapInArrow(_linker(None), "kind int, a long, b long"))
    return functools.reduce(DataFrame.unionByName, found).where("kind = 0").select("a", "b")


def near_duplicates(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, row_key, fp, component_id, keeps) for each row of docs(doc_id, text).

    component_id is the smallest doc_id of all rows reachable over links. keeps marks the rows that stand for their
    component: those of the smallest (doc_id, row_key), null ids last; they are repetitions of one row. A null text
    is the empty text, whose fingerprint is 0; a component with null ids only has a null component_id. An empty
    table gives no rows; other columns are not read.
    """
    # The part is written with the row, so it stays the same when a task is repeated.
    rows = staged(fingerprints(docs).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    parts = rows.groupBy("fp", "part").agg(best.alias("best"))
    distinct = staged(parts.groupBy("fp").agg(F.min("best").alias("best"), F.collect_list("part").alias("parts")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), hot_bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = rooted.where("root is not null")
    tops = linked.join(linked.groupBy("root").agg(F.min("best").alias("top")), "root").select("fp", "parts", "top")
    # most fingerprints have no link: they stay out of the join, where they would all have one key, null
    alone = rooted.where("root is null").select("fp", "parts", F.col("best").alias("top"))
    named = tops.unionByName(alone).select("fp", F.explode("parts").alias("part"), "top")
    return rows.join(named, ["fp", "part"]).select(
        "doc_id", "row_key", "fp", F.col("top.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("row_key") == F.col("top.row_key"))).alias("keeps"),
    )


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their near-duplicate component; a repeated row stays once.

    The row with the smallest doc_id stays, of several texts of that id the one of least hash, null ids last; of rows
    equal in id and text that differ elsewhere, the one whose other columns have the least hash (columns of maps are
    left out of it). A null text is the empty text. An empty table gives no rows. No column name can clash.
    """
    kept = near_duplicates(docs).where("keeps").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("row_key").alias("_key")).distinct()
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not _has_map(f.dataType)]
    keyed = docs.select(whole_row(docs).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("_id"), row_key(docs).alias("_key"), F.xxhash64(*hashed).alias("_rest"))
    one = keyed.join(kept, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.min_by("row", "_rest").alias("row"))
    return one.select("row.*")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row of docs; edge cases as in near_duplicates()."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
