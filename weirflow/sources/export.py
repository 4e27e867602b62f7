"""Texts made of tables: one listing and one DOT graph per graph id, and rows per stage."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, functions as F

from weirflow.plans.fixpoint import settled
from weirflow.plans.scan import HOT_ROWS, running, total


def listing(records: DataFrame, line: Column) -> DataFrame:
    """(g, text): one line per record in order. A graph is one text, so its lines meet in one row."""
    lines = F.array_sort(F.collect_list(F.struct("pc", line.alias("line"))))
    return records.groupBy("g").agg(lines.alias("l")).select("g", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("text"))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def block_listing(blocks: DataFrame, edges: DataFrame, records: DataFrame, line: Column) -> DataFrame:
    """(g, text): for each of blocks(g, b, head_pc, tail_pc) a header with the blocks before and behind it, then a line per record(g, b, pc) in order.

    edges(g, src, dst) are between blocks. A graph is one text, so its lines meet in one row.
    """
    ends = lambda own, other: edges.groupBy("g", F.col(own).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(other)), lambda x: x.cast("string")), ",").alias(f"_{own}"))
    heads = blocks.join(ends("dst", "src"), ["g", "b"], "left").join(ends("src", "dst"), ["g", "b"], "left")
    shown = F.concat(F.lit("block "), F.col("b").cast("string"), F.lit(" <- "), F.coalesce("_dst", F.lit("")), F.lit(" -> "), F.coalesce("_src", F.lit("")))
    lines = heads.select("g", "b", F.lit(-1).cast("long").alias("pc"), shown.alias("line")).unionByName(records.select("g", "b", F.col("pc").cast("long").alias("pc"), line.alias("line")))
    return lines.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("b", "pc", "line"))).alias("l")).select("g", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("text"))


def nested_listing(units: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(root, ord, id, depth, text) of trees units(id, parent, text): each unit's text behind its parent's, siblings in order of id.

    A root has no parent. A root's texts are rows in order, not one value, so a large tree is many tasks' work: its
    order is the paths of ids from the root, made a level at a time. A unit whose parent is missing is left out.
    """
    kids = settled(units.select("id", "parent", "text"))
    level = settled(kids.where("parent is null").select(F.col("id").alias("root"), "id", F.array("id").alias("path"), "text"))
    known = level
    while not level.isEmpty():
        above = level.select("root", F.col("id").alias("parent"), F.col("path").alias("_path"))
        level = settled(kids.join(above, "parent").select("root", "id", F.array_append("_path", F.col("id")).alias("path"), "text"))
        known = known.unionByName(level)
    placed = running(known, ["root"], ["path"], hot, ord=total(F.lit(1).cast("long")))
    return placed.select("root", (F.col("ord") - 1).alias("ord"), "id", (F.size("path") - 1).cast("long").alias("depth"), "text")


def edge_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(g, src, dst, ord) with label, by what nodes(g, node, kind) says of their source.

    The side taken (ord 0) and the other are skip and enter of a loop's preparation (prepare), loop and exit of its
    test (loop), true and false of a decision (decide). A plain jump that doesn't lead forward is back; others are bare.
    """
    kinds = nodes.select("g", F.col("node").alias("src"), "kind")
    taken = F.col("ord") == 0
    label = (
        F.when(F.col("kind") == "prepare", F.when(taken, "skip").otherwise("enter")).when(F.col("kind") == "loop", F.when(taken, "loop").otherwise("exit"))
        .when(F.col("kind") == "decide", F.when(taken, "true").otherwise("false")).when(F.col("dst") <= F.col("src"), "back").otherwise("")
    )
    return edges.select("g", "src", "dst", "ord").join(kinds, ["g", "src"], "left").select("g", "src", "dst", "ord", label.alias("label"))


def to_dot(edges: DataFrame, label: Column, dead: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(g, dot): one DOT text per graph, its edges in order of their ends; all texts are escaped.

    Nodes of dead(g, node) have no edges out. links(g, src, dst), to units that a node makes, are dotted and bare.
    """
    arrow = lambda tail: F.concat(F.lit('"'), escape_html(F.col("src")), F.lit('" -> "'), escape_html(F.col("dst")), F.lit('" ['), tail, F.lit("];"))
    shown = edges.select("g", "src", "dst", arrow(F.concat(F.lit('label="'), escape_html(label), F.lit('"'))).alias("a"))
    if dead is not None:
        shown = shown.join(dead.select("g", F.col("node").alias("src")).distinct(), ["g", "src"], "left_anti").select("g", "src", "dst", "a")
    if links is not None:
        shown = shown.unionByName(links.select("g", "src", "dst").distinct().withColumn("a", arrow(F.lit("style=dotted"))))
    rows = F.array_sort(F.collect_list(F.struct("src", "dst", "a")))
    return shown.groupBy("g").agg(rows.alias("l")).select("g", F.concat(F.lit("digraph g {\n"), F.array_join(F.transform("l", lambda e: e["a"]), "\n"), F.lit("\n}")).alias("dot"))


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """The table with a count of its rows taken as it is written, and what to ask for it."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def stage_metrics(df: DataFrame, stage: str, path: str) -> DataFrame:
    """Write the table and return (stage, rows, seconds)."""
    counted, seen = observed(df, stage)
    began = time.time()
    counted.write.mode("overwrite").parquet(path)
    return df.sparkSession.createDataFrame([(stage, seen.get["rows"], time.time() - began)], "stage string, rows long, seconds double")
