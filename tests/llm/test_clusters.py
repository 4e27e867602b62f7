import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np

from weirflow.llm import clusters, queries

SF = "/root/testdata/sf0.001"


def plain(rows, count=8, rounds=10):
    """k-means by the definition, in Python's integers."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in good]
    order = sorted(range(len(good)), key=lambda n: (hashlib.sha256(f"3:{'' if good[n][0] is None else good[n][0]}".encode()).hexdigest(), list(good[n][1])))
    centres = [whole[n][1] for n in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        held = [[] for _ in centres]
        for _, v in whole:
            held[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, centres)]
    most = (1 << 63) - 1
    found = [(i, *nearest(v)) for i, v in whole]
    total = {k: sum(d for _, d, own in found if own == k) for k in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((-1 if i is None else i, k, min(d, most), min(total[k], most), min(sum(total.values()), most), digest[k]) for i, d, k in found)


def rows_of(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    found = rows_of(queries.queries()["op12_centroid_clusters"](spark, SF))
    assert found == plain(rows) and len(found) == len(rows)


def test_edges(spark):
    draw = random.Random(5)
    vector = lambda scale: [float(np.float32(draw.uniform(-scale, scale))) for _ in range(64)]
    rows = [(i, vector(1)) for i in range(60)] + [(3, vector(1)), (3, vector(1)), (None, vector(1)), (70, None), (71, []), (72, [1.0] * 63), (73, [1.0] * 65)]
    rows += [(74, [None] + [0.0] * 63), (75, [float("nan")] + [0.0] * 63), (76, [float("inf")] + [0.0] * 63), (77, [0.5] * 64), (77, [0.5] * 64)]
    table = lambda part, kind="float": spark.createDataFrame([(*r, 1) for r in part], f"vec_id long, embedding array<{kind}>, cluster int")
    assert rows_of(clusters.cluster(table(rows))) == plain(rows)
    large = rows + [(80, vector(3e38)), (81, vector(1e5)), (82, vector(2e9))]  # squares beyond 64 bits
    assert rows_of(clusters.cluster(table(large))) == plain(large)
    odd = rows + [(83, [1e308] + [-1e308] * 63)]  # 1024 times it is no float any more
    assert rows_of(clusters.cluster(table(odd, "double"))) == plain(odd)
    few = rows[:5]
    assert rows_of(clusters.cluster(table(few))) == plain(few)
    same = [(i, [0.25] * 64) for i in range(20)]
    assert rows_of(clusters.cluster(table(same))) == plain(same)
    assert clusters.cluster(table(rows[63:64])).count() == 0 == clusters.cluster(table(rows).limit(0)).count()


def test_filter_spares_distances_and_loses_none():
    draw = np.random.default_rng(2)
    centres = draw.integers(-3000, 3000, (8, 64))
    vectors = centres[draw.integers(0, 8, 4000)] + draw.integers(-200, 200, (4000, 64))
    axes = clusters.Axes(vectors.astype(float))
    near = clusters.Filter(centres.tolist(), axes)
    number, distance, tried = near.nearest(vectors, *axes.rotate(vectors.astype(float)))
    every = ((vectors[:, None] - centres[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert tried < 1.2 * len(vectors)
