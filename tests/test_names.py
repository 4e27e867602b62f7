"""Names and rewrites against brute force on small tables, with frequent names and nested lists."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.operators import infer, rewrite


def plain_names(wanted, taken):
    free, out, seen = set(taken), {}, {}
    for key, name in sorted(wanted):
        n, first = seen.get(name, (0, True))
        if first and name not in free:
            out[key], seen[name] = name, (0, False)
            continue
        n += 1
        while f"v{n}_{name}" in free:
            n += 1
        out[key], seen[name] = f"v{n}_{name}", (n, False)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_match_brute_force(spark, seed):
    draw = random.Random(seed)
    wanted = [(i, "hot" if draw.random() < 0.6 else draw.choice("abc")) for i in draw.sample(range(10_000), 600)]
    taken = [f"v{draw.randint(0, 500)}_hot" for _ in range(120)] + ["v2_hot", "v3_hot", "v4_hot", "v07_a", "v1_a", "b", "v_b", "v1_none"] + ["hot"] * (seed % 2)
    out = infer.resolve_names(spark.createDataFrame(wanted, "id long, name string").repartition(7), spark.createDataFrame([(t,) for t in taken], "name string"))
    assert {r.id: r.resolved for r in out.collect()} == plain_names(wanted, taken)


def test_names_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, name string")
    assert infer.resolve_names(none, none.select("name")).count() == 0
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id long, name string")
    assert {r.resolved for r in infer.resolve_names(one, none.select("name")).collect()} == {"a", "v1_a"}


def test_reads_count_in_nested_lists_only(spark):
    # 1 = outer list, 2 and 3 nested in it
    rows = [(1, 0, "x", None, True, 1), (1, 1, "y", None, True, 2), (1, 2, "z", None, True, 2), (1, 3, None, "z", False, 2), (1, 4, None, "x", False, 3), (1, 5, None, "y", False, 3)]
    table = spark.createDataFrame(rows, "g long, pos long, target string, reads string, pure boolean, scope long")
    bodies = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1)], "g long, scope long, parent long")
    assert sorted(r.pos for r in rewrite.eliminate_dead(table, bodies=bodies).collect()) == [0, 2, 3, 4, 5]  # y is read, but in another list
    assert sorted(r.pos for r in rewrite.eliminate_dead(table).collect()) == [0, 1, 2, 3, 4, 5]


def test_constant_loops(spark):
    rows = [(1, None, False, True, True), (2, 1, None, True, None), (3, None, True, True, True), (4, 3, None, False, None), (5, None, None, True, True), (6, 5, None, False, None), (7, None, False, True, False), (8, 7, None, True, None), (9, 7, None, False, None)]
    table = spark.createDataFrame(rows, "id long, parent long, condition boolean, side boolean, loop boolean")
    assert sorted(r.id for r in rewrite.prune_constant_branches(table).collect()) == [3, 4, 5, 6, 7, 9]
    assert sorted(r.id for r in rewrite.prune_constant_branches(table.withColumn("loop", F.lit(None).cast("boolean"))).collect()) == [1, 3, 5, 6, 7, 9]
