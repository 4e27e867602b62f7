"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Each anchor, with the next content words behind it, is a signature; the set of a text's signatures is its
fingerprint. Two sets are compared through Jaccard, pruned by their lengths: sets whose lengths lie in partitions
that are not neighbours cannot reach the threshold, and a comparison stops once what is left cannot either.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import Memory, small_batches

CHAIN = 2
THRESHOLD = 0.8
#: Text of a range that one task reads, and how many ranges there are at most.
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000

# ---- fixed values: common words of four languages ----
ANCHORS = frozenset(
    """
    a an and are as at be been but by can do for from had has have he her his how i if in into is it its may more no not of
    on one or our she so than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im ist kann man mit nach nicht noch
    nur oder sein sich sie sind so über um und uns von war was wenn werden wie wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con cuando del el ella entre era eso esta este fue ha hay las lo los más mi muy no nos o para pero por porque se si sin sobre su sus también tiene todo una y ya
    """.split()
)
# ---- end of fixed values ----
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&$~^`_-=+/\\…«»„“”‘’¿¡"


def _hashes(tokens: list[str]) -> Iterator[int]:
    """64 bits of each token's word's hash, the last one telling an anchor; 0 for a token without a word."""
    for token in tokens:
        word = token.strip(_PUNCTUATION)
        yield (xxhash.xxh64_intdigest(word) & ~1 | (word in ANCHORS)) if word else 0


_words = Memory()
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def signatures(text: str) -> np.ndarray:
    """The sorted, distinct signatures of a text as unsigned 32-bit numbers; one at least.

    A text with words but no whole chain has one signature of all its words, a text without words one of itself.
    """
    tokens = text.lower().split()
    hashes = np.fromiter(map(_words.recall(set(tokens), _hashes).__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    hashes = hashes[hashes != 0]
    anchor = (hashes & np.uint64(1)).astype(bool)
    content = hashes[~anchor]
    behind = np.cumsum(~anchor)[anchor]  # content words before each anchor: the place of the next one
    whole = behind + CHAIN <= len(content)
    behind, mixed = behind[whole], hashes[anchor][whole] * _MIX[0]
    for step in range(CHAIN):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ content[behind + step]) * _MIX[1 + step % 2]
    if len(mixed):
        return np.unique((mixed >> np.uint64(32)).astype("<u4"))
    return np.array([xxhash.xxh32_intdigest(hashes.tobytes() if len(hashes) else text.encode("utf-8", "surrogatepass"))], dtype="<u4")


def told(found: np.ndarray) -> str:
    """A fingerprint as text: its signatures in order, in base 64."""
    return base64.b64encode(found.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


@lru_cache(maxsize=None)
def _lowest(partition: int, threshold: float) -> int:
    return 1 if not partition else int(_lowest(partition - 1, threshold) / threshold) + 1


def length_partition(length: int, threshold: float = THRESHOLD) -> int:
    """The partition of a set length: sets that reach the threshold lie in the same or in neighbouring ones."""
    partition = 0
    while _lowest(partition + 1, threshold) <= length:
        partition += 1
    return partition


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def pruned_likeness(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, step: int = 256) -> float | None:
    """The likeness if it reaches the threshold, else None, found out as early as lengths and what is left allow."""
    if len(a) > len(b):
        a, b = b, a
    if length_partition(len(b), threshold) - length_partition(len(a), threshold) > 1 or len(a) < threshold * len(b):
        return None
    needed = threshold / (1 + threshold) * (len(a) + len(b))
    shared = 0
    for start in range(0, len(a), step):
        if shared + len(a) - start < needed - 1e-9:
            return None
        part = a[start : start + step]
        place = np.searchsorted(b, part)
        shared += int((b[np.minimum(place, len(b) - 1)] == part).sum())
    value = shared / (len(a) + len(b) - shared)
    return value if value >= threshold else None


def compared(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, bool]:
    """The likeness, and whether it reaches the threshold: the pruned comparison decides, and only what it leaves out is counted in full."""
    value = pruned_likeness(a, b, threshold)
    return (likeness(a, b), False) if value is None else (value, True)


def edited(text: str, following: str) -> str:
    """The text with its last third, in code points, replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int, match_edited boolean, match_next boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each bucket closed by the head of the next one; a result for each row but those heads."""
    names = [x.split()[0] for x in _RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
    last = None  # bucket, doc_id, text, signatures
    with np.errstate(over="ignore"):
        for batch in small_batches(batches):
            rows = []
            for bucket, head, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_head", "doc_id", "text"))):
                found = signatures(text)
                if last and last[0] == bucket:
                    _, one, own, mine = last
                    other = edited(own, text)
                    after = signatures(other)
                    (near_edited, match_edited), (near_next, match_next) = compared(mine, after), compared(mine, found)
                    rows.append(
                        (one, len(own), hashlib.sha256(other.encode()).hexdigest(), told(mine), told(after), near_edited, near_next, len(mine), length_partition(len(mine)),
                         match_edited, match_next)
                    )
                last = None if head else (bucket, doc_id, text, found)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class _Ranges:
    """Ranges of the order (doc_id descending, nulls last, then tie) that a task reads each: their number follows the bytes.

    Ranges are cut at quantiles of doc_id. A doc_id that several quantiles fall on, and the rows without one, have a
    range for each such share, cut by the tie, which is a hash. Range numbers fall as the order goes on.
    """

    def __init__(self, rows: DataFrame, range_bytes: int, most_ranges: int) -> None:
        size, count, known = rows.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
        ranges = min(most_ranges, max(1, -(-(size or 0) // range_bytes)))
        self.of_null = 0 if known == count else max(1, round(ranges * (count - known) / count))
        shares = max(1, ranges - self.of_null)
        points = [i / shares for i in range(1, shares)]
        found = rows.agg(F.percentile_approx("doc_id", points, 4 * ranges)).first()[0] if points else None
        self.bounds = sorted(found or [])
        self.count = self.of_null + len(self.bounds) + 1

    def numbered(self, rows: DataFrame) -> DataFrame:
        """rows with _bucket, the number of their range."""
        share = F.col("_tie") / float(1 << 64) + 0.5  # the tie's place between 0 and 1
        below = F.lit(0)
        if self.bounds:
            splits = sorted({float(b) for b in self.bounds})
            upto = [bisect.bisect_right(self.bounds, x, key=float) for x in splits]
            cut = Bucketizer(splits=[-np.inf, *splits, np.inf], inputCol="_at", outputCol="_split", handleInvalid="keep")
            rows = cut.transform(rows.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
            below = F.element_at(F.lit([0, *upto]), F.col("_split").cast("int") + 1)
            often = {b: n for b, n in Counter(self.bounds).items() if n > 1 and abs(b) < 1 << 53}
            if often:  # half as many as ranges at most, and few unless ids repeat
                times = F.element_at(F.create_map(*(F.lit(x) for pair in often.items() for x in pair)), F.col("doc_id"))
                below = below - F.coalesce(F.least(F.floor(share * times), times - 1), F.lit(0))
        null = self.of_null - 1 - F.least(F.floor(share * self.of_null), F.lit(max(self.of_null - 1, 0)))
        return rows.withColumn("_bucket", F.when(F.col("doc_id").isNull(), null).otherwise(below + self.of_null).cast("int")).drop("_at", "_split")


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """For each row of docs(doc_id, text): its fingerprint, that of its edited text, and likenesses.

    The next document is the one behind in descending doc_id, after the last the first; rows of one id are in order
    of a hash of their texts, rows without id come last. A single row is its own next. A null text is the empty
    text. Repeated rows follow one another and give a row each. An empty table gives no rows; other columns are not
    read.

    The texts are shuffled once, into ranges of the order; each range is read in order by one task, row by row, and
    the one row that a range needs from beyond its end, the next range's first, is sent along with it. A range has
    about range_bytes of text; beyond most_ranges of them the ranges grow.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("_tie", F.xxhash64("text"))
    ranges = _Ranges(rows, range_bytes, most_ranges)
    keyed = ranges.numbered(rows)
    # One row per range: its first in order. Ranges follow one another downwards, and the last leads to the first.
    first = F.min_by(F.struct("doc_id", "_tie"), F.struct(F.bitwise_not("doc_id"), "_tie")).alias("f")
    heads = sorted(((r["_bucket"], r.f.doc_id, r.f["_tie"]) for r in keyed.groupBy("_bucket").agg(first).collect()), reverse=True)
    closing = [(heads[i - 1][0], *head[1:]) for i, head in enumerate(heads)]
    closing_rows = spark.createDataFrame(closing, "_bucket int, _doc long, _same long")  # at most most_ranges rows
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_same"))
    sent = rows.join(F.broadcast(closing_rows), here).select("doc_id", "text", "_tie", "_bucket", F.lit(1).alias("_head")).dropDuplicates(["_bucket"])
    dealt = keyed.select("doc_id", "text", "_tie", "_bucket", F.lit(0).alias("_head")).unionByName(sent).repartitionById(ranges.count, "_bucket")
    return dealt.sortWithinPartitions("_bucket", "_head", F.desc_nulls_last("doc_id"), "_tie").mapInArrow(_compare, _RESULT)
