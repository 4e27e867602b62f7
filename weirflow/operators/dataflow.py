"""Liveness of registers over graphs of blocks: within a row for small graphs, along straight runs for large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weirflow.operators.dominance import SMALL, straight_runs
from weirflow.plans.fixpoint import grow, settled, shuffled
from weirflow.plans.scan import previous, running


def span_access(records: DataFrame, mode: str, base: Column, count: Column) -> DataFrame:
    """(g, pc, reg, mode) for each register that a record reads or writes by a span: count of them from base on."""
    spans = records.select("g", "pc", base.cast("long").alias("_from"), count.cast("long").alias("_many")).where("_many > 0")
    return spans.select("g", "pc", F.explode(F.sequence("_from", F.col("_from") + F.col("_many") - 1)).alias("reg"), F.lit(mode).alias("mode"))


def first_access(access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads_first, writes), each (g, node, reg), of access(g, node, pc, reg, mode): a record reads (R) before it writes (W)."""
    first = F.min_by("mode", F.struct("pc", (F.col("mode") == "W").alias("after")))
    firsts = access.groupBy("g", "node", "reg").agg(first.alias("mode")).where("mode = 'R'").select("g", "node", "reg")
    return firsts, access.where("mode = 'W'").select("g", "node", "reg").distinct()


def liveness(edges: DataFrame, reads_first: DataFrame, writes: DataFrame, small: int = SMALL) -> DataFrame:
    """(g, node, reg) live into a node: read there before any write, or live into a successor and not written.

    reads_first(g, node, reg) are reads before the node's own writes(g, node, reg). Graphs of up to small nodes are
    solved in a row for each register, by bits. In larger ones a straight run of nodes acts as one: its first access
    decides, so the fixpoint goes over runs, and a run's own nodes follow from the places of its accesses by one sort.
    """
    plain = settled(edges.select("g", "src", "dst").distinct())
    accesses = settled(
        reads_first.select("g", "node", "reg", F.lit(True).alias("read")).unionByName(writes.select("g", "node", "reg", F.lit(False).alias("read")))
        .groupBy("g", "node", "reg").agg(F.bool_or("read").alias("read"), F.bool_or(~F.col("read")).alias("written"))
    )
    nodes = plain.select("g", F.col("src").alias("node")).union(plain.select("g", F.col("dst").alias("node"))).union(accesses.select("g", "node")).distinct()
    large = settled(nodes.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("g"))
    if large.isEmpty():
        return _small_liveness(plain, accesses, nodes)
    of = lambda df, how: df.join(large, "g", how)
    found = _small_liveness(of(plain, "left_anti"), of(accesses, "left_anti"), of(nodes, "left_anti"))
    return found.unionByName(_liveness_along_runs(settled(of(plain, "left_semi")), settled(of(accesses, "left_semi")), settled(of(nodes, "left_semi"))))


def _small_liveness(edges: DataFrame, accesses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Liveness of graphs whose nodes are bits: as many steps as there are nodes reach all that can be reached."""
    order = F.array_position(F.col("names"), F.col("node")) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), order.cast("int"))
    named = shuffled(nodes.groupBy("g").agg(F.array_sort(F.collect_set("node")).alias("names")))
    ways = edges.join(named, "g").select("g", F.col("src"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position("names", F.col("dst")) - 1).cast("int")).alias("_bit"))
    ahead = ways.groupBy("g", F.col("src").alias("node")).agg(F.bit_or("_bit").alias("_ahead"))
    graphs = named.join(ahead.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("node", "_ahead"))).alias("_to")), "g", "left")
    graphs = shuffled(graphs).select("g", "names", F.transform("names", lambda n: F.coalesce(F.try_element_at("_to", n), F.lit(0).cast("long"))).alias("to"))
    marked = accesses.join(named, "g").select("g", "reg", bit.alias("_bit"), "read", "written")
    none = F.lit(0).cast("long")
    masks = marked.groupBy("g", "reg").agg(
        F.coalesce(F.bit_or(F.when(F.col("read"), F.col("_bit"))), none).alias("gen"), F.coalesce(F.bit_or(F.when(F.col("written"), F.col("_bit"))), none).alias("kill")
    )
    rows = masks.where("gen <> 0").join(graphs, "g")
    one = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v)
    ids = F.sequence(F.lit(0), F.size("names") - 1)

    def step(live: Column, _: Column) -> Column:
        before = F.aggregate(ids, none, lambda m, v: m.bitwiseOR(F.when(F.get("to", v).bitwiseAND(live) != 0, one(v)).otherwise(none)))
        return F.col("gen").bitwiseOR(before.bitwiseAND(F.bitwise_not(F.col("kill"))))

    live = rows.select("g", "reg", "names", F.aggregate(ids, F.col("gen"), step).alias("live"))
    kept = F.filter(ids, lambda v: F.col("live").bitwiseAND(one(v)) != 0)
    return live.select("g", F.explode(F.transform(kept, lambda v: F.get("names", v))).alias("node"), "reg")


def _liveness_along_runs(edges: DataFrame, accesses: DataFrame, nodes: DataFrame) -> DataFrame:
    straight, runs = straight_runs(edges)
    places = settled(
        nodes.join(runs, ["g", "node"], "left").select("g", "node", F.coalesce("head", "node").alias("head"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))
    )
    found = settled(accesses.join(places, ["g", "node"]).select("g", "head", "place", "reg", "read", "written"))
    whole = found.groupBy("g", "head", "reg").agg(F.min_by("read", "place").alias("read"), F.bool_or("written").alias("written"))
    outer = edges.join(straight.select("g", F.col("next").alias("src"), F.col("node").alias("dst")), ["g", "src", "dst"], "left_anti")
    end = lambda c: places.select("g", F.col("node").alias(c), F.col("head").alias(f"_{c}"))
    drawn = settled(outer.join(end("src"), ["g", "src"]).join(end("dst"), ["g", "dst"]).select("g", F.col("_src").alias("before"), F.col("_dst").alias("head")).distinct())
    written = settled(whole.where("written").select("g", "head", "reg"))

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        return new.join(drawn, ["g", "head"]).select("g", F.col("before").alias("head"), "reg").join(written, ["g", "head", "reg"], "left_anti")

    into = grow(whole.where("read").select("g", "head", "reg"), step)
    lengths = places.groupBy("g", "head").agg((F.max("place") + 1).alias("_length"))
    behind = into.join(drawn, ["g", "head"]).select("g", F.col("before").alias("head"), "reg").distinct().join(lengths, ["g", "head"])
    events = found.select("g", "head", "reg", "place", "read").unionByName(behind.select("g", "head", "reg", F.col("_length").alias("place"), F.lit(True).alias("read")))
    events = running(events, ["g", "head", "reg"], ["place"], _before=previous(F.col("place")))
    before = F.coalesce("_before.v", F.lit(-1))
    # A read makes the register live from behind the access before it up to the read.
    spans = events.withColumn("_from", before + 1).where("read").join(lengths, ["g", "head"]).withColumn("_to", F.least("place", F.col("_length") - 1)).where("_from <= _to")
    each = spans.select("g", "head", "reg", F.explode(F.sequence("_from", "_to")).alias("place"))
    return each.join(places, ["g", "head", "place"]).select("g", "node", "reg")
