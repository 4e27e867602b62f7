"""Exact integer k-means, with a PCA-rotated filter in front of the distances.

Each vector is stored once with its leading coordinates in the principal axes and the norm of the rest. The squared
distance of the leading coordinates plus the squared difference of the norms is a lower bound of the distance to a
centroid; only centroids whose bound is not above the distance already found are verified, in integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weirflow.llm.common import staged

SIZE, SCALE = 64, 1024
CENTROIDS, ROUNDS = 8, 10
SEED = 3
#: Leading coordinates kept, and vectors that the axes are found from: those with the least hash of their id. The axes
#: decide how much the filter spares, never what comes out.
LEADING, MOST_FITTED = 8, 2_048
#: Beyond it a component's square might not add up within 64 bits; such vectors are compared with Python's integers.
_PLAIN = float(1 << 27)
#: Sums travel as digits of so many bits, so that they are exact whatever the components.
_DIGIT = 30
_MOST_LONG = (1 << 63) - 1


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x value), exact: as int64 where that is safe for distances, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if (np.abs(scaled) < _PLAIN).all():
        return scaled.astype(np.int64)
    whole = [int(s) if math.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(whole, dtype=object).reshape(values.shape)


class Axes:
    """An orthonormal basis, leading axes first, about the fitted vectors' mean."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.mean = vectors.mean(0) if len(vectors) else np.zeros(SIZE)
        centred = vectors - self.mean
        self.basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1] if len(vectors) else np.eye(SIZE)

    def rotate(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the other ones."""
        turned = (vectors - self.mean) @ self.basis
        return turned[:, :LEADING], np.sqrt((turned[:, LEADING:] ** 2).sum(1))


class Filter:
    """The centroids of a round, and which of them a vector must be compared with."""

    def __init__(self, centroids: list[list[int]], axes: Axes) -> None:
        self.exact = centroids
        self.plain = all(abs(x) < _PLAIN for c in centroids for x in c)
        if self.plain:
            self.numbers = np.array(centroids, dtype=np.int64).reshape(len(centroids), SIZE)
            self.leading, self.rest = axes.rotate(self.numbers.astype(np.float64))

    def nearest(self, vectors: np.ndarray, leading: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number of equals; and how many distances it took."""
        if vectors.dtype == object or not self.plain:
            found = [min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(self.exact)) for v in vectors.tolist()]
            return np.array([k for _, k in found], dtype=np.int64), np.array([d for d, _ in found], dtype=object), len(vectors) * len(self.exact)
        bound = ((leading[:, None, :] - self.leading[None]) ** 2).sum(2) + (rest[:, None] - self.rest[None]) ** 2
        every = np.arange(len(vectors))
        best = bound.argmin(1)
        distance = ((vectors - self.numbers[best]) ** 2).sum(1)
        # Rounding moves a bound by far less than this share of the squared norms that it is made from.
        slack = 1e-9 * ((leading**2).sum(1) + rest**2 + ((self.leading**2).sum(1) + self.rest**2).max()) + 1
        open_ = bound <= (distance + slack)[:, None]
        open_[every, best] = False
        tried = len(vectors)
        for k in range(len(self.exact)):
            rows = np.flatnonzero(open_[:, k] & (bound[:, k] <= distance + slack))
            if len(rows):
                own = ((vectors[rows] - self.numbers[k]) ** 2).sum(1)
                better = (own < distance[rows]) | ((own == distance[rows]) & (k < best[rows]))
                distance[rows[better]], best[rows[better]] = own[better], k
                tried += len(rows)
        return best, distance, tried


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def _rotating(axes: Axes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                leading, rest = axes.rotate(np.floor(_matrix(batch, "embedding", SIZE) * SCALE))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(leading.ravel()), LEADING).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), lists, pa.array(rest)], ["vec_id", "embedding", "leading", "rest"])

    return run


def _assigned(batch: pa.RecordBatch, near: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, numbers, distances): the plain vectors of a batch, then the others."""
    values = _matrix(batch, "embedding", SIZE)
    leading, rest = _matrix(batch, "leading", LEADING), batch.column("rest").to_numpy()
    plain = (np.abs(values) < _PLAIN / SCALE - 1).all(1)
    for rows in (np.flatnonzero(plain), np.flatnonzero(~plain)):
        if len(rows):
            vectors = integers(values[rows])
            number, distance, _ = near.nearest(vectors, leading[rows], rest[rows])
            yield rows, vectors, number, distance


_SUMS = "cluster int, place int, digit int, part long"


def _summing(near: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (SIZE + 1) for _ in near.exact]  # the last is the count
        for batch in batches:
            for _, vectors, number, _ in _assigned(batch, near):
                for k in range(len(totals)):
                    mine = vectors[number == k]
                    if len(mine):
                        totals[k] = [a + int(b) for a, b in zip(totals[k], [*mine.sum(0), len(mine)])]
        rows = []
        for k, sums in enumerate(totals):
            for place, total in enumerate(sums):
                digit, size, sign = 0, abs(total), 1 if total >= 0 else -1
                while size:
                    rows.append((k, place, digit, sign * (size & ((1 << _DIGIT) - 1))))
                    digit, size = digit + 1, size >> _DIGIT
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], [x.split()[0] for x in _SUMS.split(", ")])

    return run


def _assigning(near: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, _, number, distance in _assigned(batch, near):
                cluster[rows], far[rows] = number, [min(int(d), _MOST_LONG) for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors with exactly SIZE components, none null or non-finite."""
    value = F.col("embedding").cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.coalesce((F.size("embedding") == SIZE) & good, F.lit(False)))


def _by_hash(seed: int) -> list[Column]:
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), F.col("embedding").cast("array<double>")]


def centroids(rotated: DataFrame, axes: Axes, start: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after so many rounds over rotated(embedding, leading, rest).

    A round adds up each cluster's components in exact digits: 8 x 65 sums of a few digits come back, whatever the
    number of vectors. A round that changes nothing ends the search, as all later ones would change nothing either.
    """
    now = start
    for _ in range(rounds):
        near = Filter(now, axes)
        sums = [[0] * (SIZE + 1) for _ in now]
        parts = rotated.mapInArrow(_summing(near), _SUMS).groupBy("cluster", "place", "digit").agg(F.sum("part").alias("part"))
        for row in parts.collect():
            sums[row.cluster][row.place] += row.part << (_DIGIT * row.digit)
        after = [[x // s[SIZE] for x in s[:SIZE]] if s[SIZE] else c for s, c in zip(sums, now)]
        if after == now:
            break
        now = after
    return now


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector of vectors(vec_id, embedding).

    The first centroids are the kept vectors with the smallest hash of seed and id; of rows of one id the smaller
    components come first, and a null id counts as the empty string. With fewer vectors than centroids there are as
    many centroids as vectors. Distances are exact; a vector as near to two centroids goes to the smaller number; an
    empty cluster's centroid stays. Distances and sums beyond a long are its greatest value. Repeated rows count each
    for itself; an empty table, or one without a kept vector, gives no rows; other columns are not read.
    """
    good = kept(vectors)
    drawn = [list(r.embedding) for r in good.orderBy(*_by_hash(seed)).limit(count).collect()]
    start = [[int(x) for x in v] for v in integers(np.array(drawn, dtype=np.float64).reshape(len(drawn), SIZE))]
    sample = [r.embedding for r in good.orderBy(F.xxhash64("vec_id"), "embedding").limit(MOST_FITTED).collect()]
    fitted = np.array(sample, dtype=np.float64).reshape(len(sample), SIZE)
    axes = Axes(fitted[(np.abs(fitted) < _PLAIN / SCALE).all(1)] * SCALE)
    kind = good.schema["embedding"].dataType.simpleString()
    rotated = staged(good.mapInArrow(_rotating(axes), f"vec_id long, embedding {kind}, leading array<double>, rest double"), "rotated")
    final = centroids(rotated, axes, start, rounds)
    assigned = staged(rotated.mapInArrow(_assigning(Filter(final, axes)), "vec_id long, cluster int, distance long"), "assigned")
    spark = vectors.sparkSession
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(inertia.values()), _MOST_LONG)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    facts = spark.createDataFrame(
        [(k, min(total, _MOST_LONG), whole, digests[k]) for k, total in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # one row per centroid, whatever the vectors
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
