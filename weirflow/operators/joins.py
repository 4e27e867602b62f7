"""Lookups, as-of and interval joins, and links between definitions and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weirflow.operators.dominance import with_dominance
from weirflow.plans.scan import HOT_ROWS, latest, running


def lookup(rows: DataFrame, key: str, pool: DataFrame, pool_key: str, value: str, null_key: int | None = 0) -> DataFrame:
    """rows with value and status: ok, null for the null key, missing for a key that the pool has not."""
    found = pool.select(F.col(pool_key).alias("_key"), F.col(value).alias(value), F.lit(True).alias("_found"))
    out = rows.join(found, rows[key] == found["_key"], "left")
    status = F.when(F.col("_found"), "ok").when(F.col(key).isNull() | (F.col(key) == F.lit(null_key)), "null").otherwise("missing")
    return out.withColumn("status", status).drop("_key", "_found")


def zip_template(rows: DataFrame, keys: str, values: str, pool: DataFrame, pool_key: str, value: str) -> DataFrame:
    """One row per key with the value of the index beside it, as far as the shorter list goes; a bad index gives null."""
    many = F.least(F.size(keys), F.size(values))
    pairs = F.slice(F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("i")), 1, many)
    flat = rows.select("g", F.posexplode(pairs).alias("pos", "pair")).select("g", F.col("pos").cast("long").alias("pos"), F.col("pair.k").alias("key"), F.col("pair.i").alias("_i"))
    return flat.join(pool.select(F.col(pool_key).alias("_i"), F.col(value).alias("value")), "_i", "left").drop("_i")


def def_use(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(g, reg, version, def_pc, use_pc): each use beside its one definition; version 0 has none."""
    made = defs.select("g", "reg", "version", F.col("pc").alias("def_pc"))
    return uses.select("g", "reg", "version", F.col("pc").alias("use_pc")).join(made, ["g", "reg", "version"])


def as_of(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, default, include: bool = False, hot: int = HOT_ROWS) -> DataFrame:
    """probes with the value of the last mark before at (or at it, with include), by one sort of both; default where none is.

    Keys of more than hot rows are cut into stretches of the order.
    """
    both = probes.select(*probes.columns, F.lit(None).cast(marks.schema[value].dataType).alias("_value"), F.lit(1 if include else 0).alias("_turn"), F.lit(True).alias("_probe"))
    named = {c: F.col(c) if c in marks.columns and c != value else F.lit(None).cast(probes.schema[c].dataType) for c in probes.columns}
    other = marks.select(*(named[c].alias(c) for c in probes.columns), F.col(value).alias("_value"), F.lit(0 if include else 1).alias("_turn"), F.lit(False).alias("_probe"))
    # at one place a mark sorts behind the probes, or before them with include
    seen = running(both.unionByName(other), keys, [at, "_turn"], hot, _last=latest(F.col("_value"))).where("_probe")
    return seen.withColumn(value, F.coalesce("_last", F.lit(default))).drop("_last", "_value", "_turn", "_probe")


def block_of(records: DataFrame, blocks: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(g, pc, b): the block whose range holds a record; -1 where none does."""
    found = as_of(records.select("g", "pc"), blocks.select("g", F.col("head_pc").alias("pc"), F.struct("b", "tail_pc").alias("blk")), ["g"], "pc", "blk", None, True, hot)
    return found.select("g", "pc", F.when(F.col("pc") <= F.col("blk.tail_pc"), F.col("blk.b")).otherwise(-1).alias("b"))


def in_scope(records: DataFrame, scopes: DataFrame) -> DataFrame:
    """records joined with scopes(g, reg, name, start_pc, end_pc) that hold their register at their place, half open.

    A scope lies in one or two cells of the least power of two of places that is no shorter than it, whatever its
    length. A record looks into one cell for each such size that its register has, 64 at most; of the scopes in a
    cell at least a quarter of the places are held. So a register of many scopes, or of long ones, is not one key.
    """
    inside = lambda pc: F.expr(f"shiftright({pc}, _size)")
    length = F.col("end_pc") - F.col("start_pc")
    sized = scopes.where("start_pc < end_pc").select("g", "reg", "name", "start_pc", "end_pc", F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).alias("_size"))
    dealt = sized.withColumn("_cell", F.explode(F.array_distinct(F.array(inside("start_pc"), inside("end_pc - 1")))))
    looking = records.join(sized.select("g", "reg", "_size").distinct(), ["g", "reg"]).withColumn("_cell", inside("pc"))
    return looking.join(dealt, ["g", "reg", "_size", "_cell"]).where("start_pc <= pc and pc < end_pc").drop("start_pc", "end_pc", "_size", "_cell")


def name_collisions(own: DataFrame, captured: DataFrame) -> DataFrame:
    """own(id, name) with resolved: a name that is captured too gets its unit as suffix."""
    taken = captured.select("name").distinct().withColumn("_taken", F.lit(True))
    return own.join(taken, "name", "left").select("id", "name", F.when(F.col("_taken"), F.concat("name", F.lit("_"), F.col("id").cast("string"))).otherwise(F.col("name")).alias("resolved"))


def dominates(pairs: DataFrame, dom: DataFrame) -> DataFrame:
    """The pairs(g, d, n) in which d dominates n, by the tree's intervals."""
    return with_dominance(pairs.select("g", "d", "n"), dom, "d", "n").where("_over").select("g", "d", "n")


def same_source(inputs: DataFrame, consumer: str, source: str, n: int) -> DataFrame:
    """Consumers with exactly n inputs, all of one source."""
    return inputs.groupBy(consumer).agg(F.count("*").alias("n"), F.min(source).alias("source"), F.max(source).alias("_most")).where((F.col("n") == n) & (F.col("source") == F.col("_most"))).drop("_most")


def links(children: DataFrame, parents: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Plain equi-join of records to the units that they create."""
    return parents.join(children, on, how)
