"""Settled tables of many rows: files say little of what they take in memory."""

import pytest
from pyspark.sql import functions as F

from weirflow.operators import dominance, graph
from weirflow.plans import fixpoint
from weirflow.plans.fixpoint import SHUFFLED_ROWS, grow, settled, together


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    return settled(spark.range(2 * SHUFFLED_ROWS).select("id", F.lit("the same in all").alias("name")))


def test_many_rows_are_not_broadcast(spark, many):
    other = spark.range(10 * SHUFFLED_ROWS)
    assert "BroadcastExchange" not in plan(other.join(many, "id"))
    assert "BroadcastExchange" not in plan(other.join(many.groupBy("id").count(), "id", "left"))
    assert other.join(many, "id").count() == 2 * SHUFFLED_ROWS


def test_few_rows_may_be_broadcast(spark):
    few = settled(spark.range(10))
    assert "BroadcastExchange" in plan(spark.range(10 * SHUFFLED_ROWS).join(few, "id"))


def test_parts_together_are_not_broadcast(spark):
    part = lambda a, b: settled(spark.range(a, b).select("id", F.lit("the same in all").alias("name")))
    both = together(part(0, SHUFFLED_ROWS - 9), part(SHUFFLED_ROWS - 9, SHUFFLED_ROWS + 9))
    assert "BroadcastExchange" not in plan(spark.range(10 * SHUFFLED_ROWS).join(both, "id"))
    found = grow(spark.range(SHUFFLED_ROWS - 9).toDF("id"), lambda new, _: new.where(f"id < {2 * SHUFFLED_ROWS}").select((F.col("id") + SHUFFLED_ROWS // 2).alias("id")))
    assert "BroadcastExchange" not in plan(spark.range(10 * SHUFFLED_ROWS).join(found, "id"))


def test_trees_and_loops_of_many_graphs_are_not_broadcast(spark):
    graphs = spark.range(SHUFFLED_ROWS // 2 + 1).withColumnRenamed("id", "g")
    edges = settled(graphs.select("g", F.explode(F.expr("array(struct('a' as src, 'b' as dst), struct('b' as src, 'a' as dst), struct('b' as src, 'c' as dst))")).alias("e")).select("g", "e.*"))
    dom = dominance.dominators(edges, graphs.select("g", F.lit("a").alias("node")))
    looped = graph.loops(edges, dom)
    assert "BroadcastExchange" not in plan(dominance.back_edges(edges, dom))
    assert "BroadcastExchange" not in plan(looped)
    assert looped.agg(F.count("*"), F.min("exit"), F.max("exit")).first()[:] == (SHUFFLED_ROWS // 2 + 1, "c", "c")


def test_exits_and_diamonds_of_many_graphs_are_not_broadcast(spark):
    graphs = spark.range(SHUFFLED_ROWS + 1).withColumnRenamed("id", "g")
    edges = settled(graphs.select("g", F.explode(F.expr("array(struct('a' as src, 'b' as dst), struct('b' as src, 'a' as dst), struct('b' as src, 'c' as dst), struct('a' as src, 'c' as dst))")).alias("e")).select("g", "e.*"))
    dom = dominance.dominators(edges, graphs.select("g", F.lit("a").alias("node")))
    looped = settled(graph.loops(edges, dom))
    inner = graph.innermost_loop(dom, looped.select("g", "header"))
    for found in (inner, graph.classify_exits(edges, inner, looped, dom), graph.endless_loops(edges, dom, looped), graph.boolean_diamonds(edges)):
        assert "BroadcastExchange" not in plan(found)


def test_contracted_runs_of_many_graphs_are_not_broadcast(spark):
    graphs = spark.range(SHUFFLED_ROWS // 2 + 1).withColumnRenamed("id", "g")
    edges = settled(graphs.select("g", F.explode(F.expr("array(struct('a' as src, 'b' as dst), struct('b' as src, 'c' as dst), struct('c' as src, 'd' as dst))")).alias("e")).select("g", "e.*"))
    found = graph.contract_passthrough(edges, edges.where("src <> 'a'").select("g", F.col("src").alias("node")))
    assert "BroadcastExchange" not in plan(found)
    assert found.agg(F.count("*"), F.min("src"), F.max("dst")).first()[:] == (SHUFFLED_ROWS // 2 + 1, "a", "d")


def test_ended_chains_are_not_asked_again(spark, monkeypatch):
    """One long chain beside many short ones, and circles with ways in: all tops, and few rows in later rounds."""
    written = []
    kept = fixpoint.settled
    monkeypatch.setattr(fixpoint, "settled", lambda df, name="round": written.append(kept(df, name)) or written[-1])
    short = [(g, 0, 1) for g in range(1, 2001)]
    long = [(0, i, i + 1) for i in range(300)]
    circles = [(-1, 1, 2), (-1, 2, 3), (-1, 3, 1), (-1, 9, 2), (-2, 1, 2), (-2, 2, 3), (-2, 3, 4), (-2, 4, 1), (-2, 8, 3), (-2, 7, 8)]
    links = spark.createDataFrame(short + long + circles, "g long, node long, next long")
    found = {(r.g, r.node): (r.top, r.steps) for r in fixpoint.jump(links).collect()}
    assert found == (
        {(g, n): (1, 1 - n) for g in range(1, 2001) for n in (0, 1)} | {(0, i): (300, 300 - i) for i in range(301)}
        | {(g, n): (1, None) for g, nodes in ((-1, (1, 2, 3, 9)), (-2, (1, 2, 3, 4, 7, 8))) for n in nodes}
    )
    assert max(t.count() for t in written[3:]) < 400
    largest = {(r.g, r.node): r.top for r in fixpoint.jump(links.where("g < 0"), F.greatest).collect()}
    assert largest == {(g, n): top for g, nodes, top in ((-1, (1, 2, 3, 9), 3), (-2, (1, 2, 3, 4, 7, 8), 4)) for n in nodes}
