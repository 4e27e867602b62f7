import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from weirflow.llm import spotsigs, spotsigs_join


def plain_classes(rows, threshold):
    """Smallest id by row, from all pairs of rows."""
    with np.errstate(over="ignore"):
        sets = [set(spotsigs.signatures(text or "").tolist()) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-12:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sets, [least.get(root(i)) for i in range(len(rows))]


def chains(draw, size, words=4000):
    return [f"the w{draw.randrange(words)} w{draw.randrange(words)}" for _ in range(size)]


def varied(draw, parts, share):
    return [p if draw.random() > share else chains(draw, 1)[0] for p in parts]


def documents(draw):
    rows = [(i, " ".join(chains(draw, draw.choice([0, 1, 3, 4, 5, 9, 30, 200])))) for i in range(120)]
    for _ in range(40):  # families: copies whose likeness lies on both sides of the threshold, at all lengths
        base = chains(draw, draw.choice([4, 5, 6, 9, 12, 40, 150, 700]))
        for _ in range(draw.randint(2, 6)):
            part = varied(draw, base, draw.choice([0, 0.05, 0.1, 0.2]))
            rows.append((draw.randrange(-500, 9000), " ".join(part[: draw.randint(len(part) * 3 // 4, len(part))])))
    shared = chains(draw, 8)  # a passage that many documents share
    rows += [(20_000 + i, " ".join(shared + chains(draw, draw.randint(0, 9)))) for i in range(60)]
    return rows + [(9_500, None), (9_501, ""), (None, None), (None, "the w1 w2 alone"), (None, "the w1 w2 alone"), (9_502, "words only"), (9_503, "words only")] + rows[:3]


def test_classes_match_all_pairs(spark):
    draw = random.Random(3)
    rows = documents(draw)
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string").repartition(3)
    for threshold, hot_list in ((0.8, 8_000), (0.8, 20), (0.6, 25)):
        sets, classes = plain_classes(rows, threshold)
        expected = sorted((i is None, i or 0, len(s), spotsigs.length_partition(len(s), threshold), c is None, c or 0) for (i, _), s, c in zip(rows, sets, classes))
        found = spotsigs_join.near_duplicates(docs, threshold, hot_list).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_signatures, r.length_partition, r.class_id is None, r.class_id or 0) for r in found) == expected
        assert len(set(classes)) < len({tuple(sorted(s)) for s in sets})  # there are links between different sets


def test_a_large_group_gives_few_pairs(spark):
    draw = random.Random(4)
    base = chains(draw, 60)
    near = [(i, " ".join(varied(draw, base, 0.03))) for i in range(600)]
    far = [(1_000 + i, " ".join(varied(draw, base, 0.3))) for i in range(100)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    sets, classes = plain_classes(near + far, 0.8)
    with np.errstate(over="ignore"):
        distinct = {spotsigs.signatures(t).tobytes() for _, t in near + far}
    table = spark.createDataFrame([(bytes([i >> 8, i & 255]), bytearray(x)) for i, x in enumerate(sorted(distinct))], "set_id binary, signatures binary")
    links = spotsigs_join.links(table)
    count = links.count()
    assert len(distinct) - 1 - 100 <= count < 40 * len(distinct)  # of about 200,000 pairs that are alike
    expected = sorted((i, c) for (i, _), c in zip(near + far, classes))
    for hot_list in (8_000, 100):
        assert sorted((r.doc_id, r.class_id) for r in spotsigs_join.near_duplicates(docs, hot_list=hot_list).collect()) == expected
    listed = table.mapInArrow(spotsigs_join._lists(spark.sparkContext.broadcast(spotsigs_join._rarity(table)), 0.8), spotsigs_join._MET)
    assert listed.groupBy("key").count().where("count > 100").count() > 5  # lists that were cut into blocks


def test_sets_that_reach_the_threshold_meet():
    """Any two such sets are listed under a common key, one of them in its own partition, and pruning keeps them."""
    draw = np.random.default_rng(5)
    counts = SimpleNamespace(value=draw.integers(0, 5, spotsigs_join.COUNTS))
    for threshold in (0.5, 0.8, 0.9):
        for _ in range(300):
            a = np.unique(draw.integers(0, 1 << 32, size=draw.integers(1, 120), dtype=np.uint64)).astype("<u4")
            b = np.unique(np.r_[a[draw.random(len(a)) < draw.choice([0.8, 0.9, 1.0])], draw.integers(0, 1 << 32, size=draw.integers(0, 6), dtype=np.uint64).astype("<u4")])
            if not len(b) or np.array_equal(a, b) or spotsigs.likeness(a, b) < threshold:
                continue
            batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b"], pa.binary()), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["set_id", "signatures"])
            rows = pa.Table.from_batches(spotsigs_join._lists(counts, threshold)(iter([batch]))).sort_by([("key", "ascending"), ("set_id", "ascending")])
            told = pa.Table.from_batches(spotsigs_join._finder(threshold, True, None)(iter(rows.combine_chunks().to_batches()))).to_pylist()
            assert {(r["set_id"], r["other"]) for r in told} == {(b"a", b"b")}


def test_empty_single_and_hot_copies(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spotsigs_join.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(7, "the cat sat of them all")], "doc_id long, text string")
    assert [tuple(r) for r in spotsigs_join.near_duplicates(one).collect()] == [(7, 1, 0, 7)]
    copies = spark.range(3000).selectExpr("id as doc_id", "'the cat sat of them all' as text")
    assert spotsigs_join.near_duplicates(copies).where("class_id = 0").count() == 3000
    with pytest.raises(ValueError):
        spotsigs_join.near_duplicates(one, 1.0)
