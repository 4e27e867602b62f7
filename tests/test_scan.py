import random

from pyspark.sql import functions as F

from weirflow.functions import decode
from weirflow.operators import dominance, graph, infer, joins, ordering, rewrite, segment
from weirflow.plans.scan import highest, latest, previous, running, total


def rows_of(draw):
    sizes = {1: 900, 2: 40, 3: 1, None: 300}
    return [(g, pc, draw.choice([None, *range(-5, 6)]), draw.random() < 0.2) for g, n in sizes.items() for pc in range(n)]


def test_stretches_give_what_one_window_gives(spark):
    rows = rows_of(random.Random(1))
    df = spark.createDataFrame(rows, "g long, pc long, v long, flag boolean").repartition(3)
    values = dict(
        s=total(F.col("v")), before=total(F.col("v"), own=False), most=highest(F.col("v"), own=False), seen=latest(F.col("v")), last=latest(F.when(F.col("flag"), F.col("pc")), own=False), prior=previous(F.col("v")),
    )
    found, expected = ({tuple(r) for r in running(df, ["g"], ["pc"], hot, **values).select("g", "pc", *values).collect()} for hot in (100, 10_000))
    assert found == expected and len(found) == len(rows)


def test_a_hot_graph_is_no_one_tasks_work(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("pc"), (F.col("id") % 7).alias("reg"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be drawn together again
    try:
        out = segment.number_versions(df, hot=1_000).withColumn("task", F.spark_partition_id())
        shares = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == 20_000 and max(shares) < 15_000, shares
    assert out.where("version <> floor(pc / 7) + 1").isEmpty()
    ends = F.col("reg") == 3
    plain, cut = (segment.assign_blocks(df, ends, hot=n) for n in (10**6, 1_000))
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty() and plain.count() == 2858
    targets = spark.createDataFrame([(1, 5), (1, 4), (1, 19_999)], "g long, pc long")
    plain, cut = (segment.with_blocks(df, ends, targets, hot=n) for n in (10**6, 1_000))
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()
    assert segment.high_water(df, F.col("reg") == 0, hot=1_000).where("span <> 6 and pc > 0").isEmpty()


def test_as_of_over_stretches(spark):
    draw = random.Random(2)
    marks = [(1, pc, draw.randint(0, 99)) for pc in sorted(draw.sample(range(3000), 200))] + [(2, 5, 7)]
    probes = [(1, pc) for pc in draw.sample(range(3000), 800)] + [(2, 4), (2, 5), (2, 6), (3, 1)]
    m, p = spark.createDataFrame(marks, "g long, pc long, v long"), spark.createDataFrame(probes, "g long, pc long")
    for include in (False, True):
        expected = {(g, pc, max(((at, v) for h, at, v in marks if h == g and (at < pc or include and at == pc)), default=(0, -1))[1]) for g, pc in probes}
        assert {tuple(r) for r in joins.as_of(p, m, ["g"], "pc", "v", -1, include, hot=50).collect()} == expected


def test_many_redefinitions_of_one_register(spark):
    size = 60_000
    df = spark.range(size).select(F.lit(1).alias("g"), F.col("id").alias("pc"), F.lit(0).alias("reg"), F.when(F.col("id") % 10 == 0, "signup").when(F.col("id") % 10 == 5, "purchase").otherwise("view").alias("op"))
    out = segment.collect_until_barrier(df, F.col("op") == "signup", F.col("op") == "view", F.lit(False), 100, F.col("op") == "purchase", hot=5_000)
    assert out.count() == size // 10 and out.where("n <> 4").isEmpty()


def test_windows_over_stretches_equal_those_in_one(spark):
    draw = random.Random(5)
    rows = [(g, pc, draw.choice(["call", "arg", "arg", "ret", None]), draw.randrange(3), draw.randrange(-40, 200)) for g, n in ((1, 700), (2, 30), (3, 1)) for pc in range(n)]
    df = spark.createDataFrame(rows, "g long, pc long, op string, reg long, d long").repartition(3)
    blocked = segment.with_blocks(df, F.col("op") == "ret")
    ways = [
        lambda hot: segment.pair_with_previous(df, 2, hot), lambda hot: segment.trailing_run(df, "call", "arg", hot), lambda hot: segment.decode_line_deltas(df, "d", 3, hot),
        lambda hot: segment.fallthrough(blocked.select("g", "b").distinct(), hot), lambda hot: segment.classify_blocks(blocked, {"ret": "RETURN_OP"}, offset="d", loop_ops=["call"], hot=hot),
    ]
    for way in ways:
        found, expected = (sorted(map(repr, way(hot).collect())) for hot in (50, 10_000))
        assert found == expected and found
    by_place = {(g, pc): (op, reg) for g, pc, op, reg, _ in rows}
    paired = {(g, pc, pc - 2) for (g, pc), (op, reg) in by_place.items() if op and by_place.get((g, pc - 2)) == (op, reg)}
    assert {tuple(r) for r in segment.pair_with_previous(df, 2, 50).collect()} == paired


def test_scopes_of_any_length(spark):
    draw = random.Random(6)
    scopes = [(1, draw.randrange(2), f"s{i}", (start := draw.randrange(-50, 900)), start + draw.choice([0, 1, 2, 3, 5, 8, 64, 65, 400, 10**12])) for i in range(120)]
    records = [(g, pc, reg) for g in (1, 2) for pc in range(-60, 1000, 3) for reg in (0, 1, 2)]
    expected = sorted((g, pc, reg, name) for g, pc, reg in records for h, r, name, start, end in scopes if (g, reg) == (h, r) and start <= pc < end)
    out = joins.in_scope(spark.createDataFrame(records, "g long, pc long, reg long"), spark.createDataFrame(scopes, "g long, reg long, name string, start_pc long, end_pc long"))
    assert sorted((r.g, r.pc, r.reg, r.name) for r in out.collect()) == expected


def test_hot_words_links_names_and_children_over_stretches(spark):
    draw = random.Random(8)
    rows = [(g, pc, draw.randrange(8), draw.choice("xyz")) for g, n in ((1, 600), (2, 25), (3, 1)) for pc in range(n)]
    df = spark.createDataFrame(rows, "g long, pc long, word long, name string").repartition(3)
    words = df.select("g", F.col("pc").alias("pos"), "word", "name")
    blocks = df.select("g", F.col("pc").alias("b"), F.col("pc").alias("head_pc"))
    jumps = df.where("word < 4").select("g", F.col("pc").alias("b"), (F.col("pc") + F.col("word")).alias("target_pc"), (F.col("word") < 2).alias("conditional"))
    star = spark.createDataFrame([(1, f"n{draw.randrange(40)}", f"n{draw.randrange(400)}", r) for r in ("true", "false", "jump", "next") for _ in range(200)], "g long, src string, dst string, role string")
    renames = df.where("word = 3").select("g", "pc", "name", F.concat(F.lit("r"), F.col("pc").cast("string")).alias("renamed"))
    # two trees of a graph: a root with 300 children, one of which has 150 of its own
    tree = [(1, "a", None), (1, "b", None)] + [(1, f"c{i}", "a") for i in range(300)] + [(1, f"d{i}", "c7") for i in range(150)] + [(2, "a", None), (2, "b", "a")]
    idoms = spark.createDataFrame(tree, "g long, node string, idom string")
    ways = [
        lambda hot: decode.split_aux(words, F.col("word") % 2 == 0, hot), lambda hot: graph.link_blocks(blocks, jumps, hot), lambda hot: graph.number_links(star, hot),
        lambda hot: ordering.order_predecessors(star, star.where("src > dst"), hot), lambda hot: infer.apply_renames(df, renames, hot),
        lambda hot: rewrite.collapse_update_chains(words, "name", F.col("word").cast("string"), hot), lambda hot: dominance.labelled(idoms, hot),
        lambda hot: segment.collect_until_barrier(df.withColumn("reg", F.col("word")), F.col("word") == 1, F.col("word") > 4, F.col("word") == 0, 10, hot=hot),
    ]
    for way in ways:
        found, expected = (sorted(map(repr, way(hot).collect())) for hot in (20, 10_000))
        assert found == expected and found
    labels = {(r.g, r.node): r for r in dominance.labelled(idoms, 20).collect()}
    assert len(labels) == len(tree) and sorted(r.pre for (g, _), r in labels.items() if g == 1) == list(range(452))
    for g, node, idom in tree:
        own = labels[g, node]
        assert own.depth == (0 if idom is None else labels[g, idom].depth + 1)
        assert idom is None or labels[g, idom].pre < own.pre <= own.last <= labels[g, idom].last
    assert labels[1, "c7"].last - labels[1, "c7"].pre == 150
