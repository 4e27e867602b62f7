"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import staged


#: The neighbours of a node are dealt over so many keys, so that a star's centre is not one task's work.
SPREAD = 128


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the smallest v of each u.

    The minimum goes up a tree and down again: from the pairs to the parts of a node, from these, at most SPREAD, to
    the node, whose row goes back to its parts. A node with very many neighbours is never one key of a shuffle.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    return dealt.join(least.select("u", F.explode("parts").alias("part"), "m"), ["u", "part"]).select("u", "v", "m")


def _hooked(pairs: DataFrame) -> DataFrame:
    """Every neighbour v > u of a node u is hooked to the smallest of u and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _gathered(pairs: DataFrame) -> DataFrame:
    """Every node u and its neighbours v < u are hooked to the smallest of those neighbours."""
    found = _with_least(pairs)
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return found.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that it reaches.

    Self edges and edges with a null end are ignored, so their nodes come only if another edge has them. No edge
    gives an empty table. A node with very many neighbours is dealt over SPREAD keys. More than most_rounds rounds
    raise.
    """
    pairs = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = lambda df: df.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(pairs)
    for _ in range(most_rounds):
        if not before[0]:
            break
        pairs = staged(_gathered(_hooked(pairs)), "stars")
        after = state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
