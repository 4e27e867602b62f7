import random

from weirflow.operators import dataflow


def plain_liveness(edges, reads, writes):
    live = set(reads)
    before = {}
    for g, a, b in edges:
        before.setdefault((g, b), []).append(a)
    queue = list(live)
    while queue:
        g, n, r = queue.pop()
        for p in before.get((g, n), []):
            if (g, p, r) not in live and (g, p, r) not in writes:
                live.add((g, p, r))
                queue.append((g, p, r))
    return live


def tables(spark, edges, reads, writes):
    return (
        spark.createDataFrame(edges, "g long, src long, dst long"), spark.createDataFrame(sorted(reads), "g long, node long, reg long"),
        spark.createDataFrame(sorted(writes), "g long, node long, reg long"),
    )


def test_random_graphs_by_bits_and_along_runs(spark):
    draw = random.Random(7)
    edges, reads, writes = [], set(), set()
    for g in range(30):
        size = draw.randint(1, 12)
        edges += [(g, i, i + 1) for i in range(size - 1) if draw.random() < 0.9] + [(g, draw.randrange(size), draw.randrange(size)) for _ in range(draw.randint(0, 4))]
        reads |= {(g, draw.randrange(size), draw.randrange(3)) for _ in range(draw.randint(0, 4))}
        writes |= {(g, draw.randrange(size), draw.randrange(3)) for _ in range(draw.randint(0, 5))}
    edges += [(90, 0, 1), (90, 1, 2), (90, 2, 0)]  # a circle that is all one run
    reads |= {(90, 1, 0)}
    expected = plain_liveness(edges, reads, writes)
    for small in (dataflow.SMALL, 0):
        found = [tuple(r) for r in dataflow.liveness(*tables(spark, edges, reads, writes), small).collect()]
        assert sorted(found) == sorted(expected), small
    assert dataflow.liveness(*(t.limit(0) for t in tables(spark, edges, reads, writes))).count() == 0


def test_a_long_chain_of_blocks(spark):
    size, draw = 50_000, random.Random(8)
    edges = [(1, i, i + 1) for i in range(size)] + [(1, size // 2, 0)]
    reads = {(1, draw.randrange(size), draw.randrange(5)) for _ in range(60)}
    writes = {(1, draw.randrange(size), draw.randrange(5)) for _ in range(60)}
    found = dataflow.liveness(*tables(spark, edges, reads, writes)).groupBy("reg").agg({"node": "sum", "*": "count"}).collect()
    expected = plain_liveness(edges, reads, writes)
    assert {(r.reg, r["sum(node)"], r["count(1)"]) for r in found} == {(x, sum(n for _, n, r in expected if r == x), sum(r == x for _, _, r in expected)) for x in {r for _, _, r in expected}}


def test_a_record_reads_before_it_writes(spark):
    access = spark.createDataFrame([(1, 0, 5, 1, "W"), (1, 0, 5, 1, "R"), (1, 0, 6, 2, "W"), (1, 0, 7, 2, "R")], "g long, node long, pc long, reg long, mode string")
    reads, writes = dataflow.first_access(access)
    assert [r.reg for r in reads.collect()] == [1] and sorted(r.reg for r in writes.collect()) == [1, 2]
    records = spark.createDataFrame([(1, 3, 2, 2), (1, 4, 0, 0), (1, 5, 1, None)], "g long, pc long, base long, n long")
    assert {tuple(r) for r in dataflow.span_access(records, "W", records["base"], records["n"]).collect()} == {(1, 3, 2, "W"), (1, 3, 3, "W")}
