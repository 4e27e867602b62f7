import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from weirflow.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return sorted((rows[i][0] is None, rows[i][0] or 0, f"{fps[i]:016x}", least[root(i)]) for i in range(len(rows)))


def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [draw.choice(words) for _ in range(300)]
        for _ in range(draw.choice([1, 2, 9])):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(draw.randint(0, 3)):
                base[draw.randrange(len(base))] = draw.choice(words)
    rows += ["", None, " \n\t", "One two", "one TWO", "É é", "a b c d", "a b c d", "x" * 50_000, "p q\x0br\x0cs\rt"]
    rows = list(enumerate(rows))
    return rows + [rows[0], (None, "One two"), (None, None)]


def test_matches_brute_force_with_and_without_hot_buckets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = plain_components(rows)
    for hot in (simhash.HOT_BUCKET, 2):
        found = simhash.near_duplicates(docs, hot_bucket=hot).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as f", "component_id").collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.f, r.component_id) for r in found) == expected


def test_bucket_search_links_all():
    draw = np.random.default_rng(3)
    center = int(draw.integers(1 << 62))
    fps = {center}
    while len(fps) < 300:
        one = list(fps)[int(draw.integers(len(fps)))]
        for bit in draw.integers(64, size=int(draw.integers(1, 6))):
            one ^= 1 << int(bit)
        fps.add(one)
    members = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    forest = simhash._Forest()
    for a, b in simhash._search(members):
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        forest.joins(a, b)
    brute = simhash._Forest()
    for i, a in enumerate(members.tolist()):
        for b in members[:i].tolist():
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                brute.joins(a, b)
    same = lambda f: {(i, j) for i in range(300) for j in range(i) if f._root(int(members[i])) == f._root(int(members[j]))}
    assert same(forest) == same(brute)


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (2, "other words here now", "z"), (None, None, "n"), (None, None, "m")],
        "doc_id long, text string, _key string",
    )
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 2), (True, 0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.query(empty).count() == 0
    assert simhash.query(empty).schema["component_id"].dataType == T.LongType()


def test_clashing_names_keep_their_values(spark):
    rows = [(1, "a b c d e", "X", "K", "r", 7, {"m": 1}), (2, "a b c d e", "Y", "L", "s", 8, {"m": 2}), (3, "quite other words here", "Z", "M", "t", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key string, row string, part int, extra map<string,int>")
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_id"], r["_key"], r.row, r.part) for r in kept.collect()) == [(1, "X", "K", "r", 7), (3, "Z", "M", "t", 9)]


def test_of_rows_equal_in_id_and_text_always_the_same_stays(spark):
    rows = [(1, "a b c d e", x) for x in "pqrstuvw"]
    chosen = {simhash.keep_one_each(spark.createDataFrame(order, "doc_id long, text string, source string")).first().source for order in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(chosen) == 1


def test_a_large_star_and_many_copies_are_spread(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(500)]
    rows = [(i, " ".join(base[:-1] + [f"z{i}"])) for i in range(400)] + [(1000 + i, "the very same text in each of these rows") for i in range(400)] + [(2000, "one that stands alone among them all")]
    found = {r.doc_id: r.component_id for r in simhash.query(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {k: v for k, _, _, v in [(x[1], 0, 0, x[3]) for x in plain_components(rows)]}
    assert found[1399] == 1000 and found[2000] == 2000


def test_components_of_a_star_and_a_path(spark):
    from weirflow.llm.components import connected_components

    edges = [(5000, i) for i in range(1000)] + [(i, i + 1) for i in range(6000, 6040)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in [*range(1000), 5000]}, **{i: 6000 for i in range(6000, 6041)}}


def test_a_dense_bucket_above_the_last_level_loses_no_link(spark):
    draw = np.random.default_rng(9)
    base = int(draw.integers(1 << 62)) & ~0xFFF
    fps = sorted({base | int(x) for x in draw.integers(1 << 12, size=250)})  # all alike in 52 bits: no key parts them
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot_bucket=40).collect()
    told, brute = simhash._Forest(), simhash._Forest()
    for r in found:
        assert (r.a ^ r.b).bit_count() <= 4
        told.joins(r.a, r.b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                brute.joins(a, b)
    assert all((told._root(a) == told._root(b)) == (brute._root(a) == brute._root(b)) for i, a in enumerate(fps) for b in fps[:i])
    keys = simhash._block_pairs(spark.createDataFrame([(1, x) for x in fps], "key long, fp long"), 40).groupBy("key").count()
    assert keys.agg({"count": "max"}).first()[0] < 80
