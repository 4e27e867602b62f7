"""Ordered choices and bounded searches, and set operations on reached nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weirflow.plans.fixpoint import settled
from weirflow.plans.scan import HOT_ROWS, running, total


def order_predecessors(edges: DataFrame, latches: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(g, dst, src, ord): predecessors by name, a loop's latch(g, dst, src) last. A node of more than hot ways in is cut into stretches."""
    marked = edges.select("g", "src", "dst").distinct().join(latches.select("g", "dst", "src").distinct().withColumn("_latch", F.lit(True)), ["g", "dst", "src"], "left")
    rows = running(marked.withColumn("_latch", F.coalesce("_latch", F.lit(False))), ["g", "dst"], ["_latch", "src"], hot, _place=total(F.lit(1).cast("long")))
    return rows.select("g", "dst", "src", (F.col("_place") - 1).alias("ord"))


def first_rule(rows: DataFrame, keys: list[str], rules: DataFrame, method: str) -> DataFrame:
    """keys and result: of rules(priority, method, result) that match a row's method, the one of lowest priority."""
    matched = rows.join(rules.select("priority", F.col("method").alias("_m"), "result"), rows[method] == F.col("_m"))
    return matched.groupBy(*keys).agg(F.min_by("result", "priority").alias("result"))


def bounded_reach(edges: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(g, n, truncated): nodes reached per graph when the search stops after the round that reaches limit nodes."""
    known = settled(entries.select("g", "node").distinct())
    newest = known
    while True:
        full = known.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        found = newest.join(edges.select("g", F.col("src").alias("node"), "dst"), ["g", "node"]).join(full, "g", "left_anti").select("g", F.col("dst").alias("node")).distinct()
        newest = settled(found.join(known, ["g", "node"], "left_anti"))
        if newest.isEmpty():
            # a graph is cut where a reached node has a successor that is not reached
            beyond = known.join(edges.select("g", F.col("src").alias("node"), "dst"), ["g", "node"]).select("g", F.col("dst").alias("node")).distinct().join(known, ["g", "node"], "left_anti")
            cut = beyond.select("g").distinct().withColumn("_cut", F.lit(True))
            return known.groupBy("g").agg(F.count("*").alias("n")).join(cut, "g", "left").select("g", "n", F.coalesce("_cut", F.lit(False)).alias("truncated"))
        known = settled(known.unionByName(newest))


def common_reach(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, node) in both."""
    return a.select("g", "node").intersect(b.select("g", "node"))


def unreached(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """nodes, with their attributes, that are not reached."""
    return nodes.join(reached.select("g", "node").distinct(), ["g", "node"], "left_anti")


def merge_facts(*collected: DataFrame) -> DataFrame:
    """(g, source, pos, type) of all evidence: source ranks the collectors in the order given, pos keeps their own order."""
    return reduce(DataFrame.unionByName, (f.select("g", F.lit(rank).cast("long").alias("source"), "pos", "type") for rank, f in enumerate(collected)))
