"""Aggregations over definitions, uses and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def use_counts(uses: DataFrame) -> DataFrame:
    """(g, reg, version, n, single): uses of each version."""
    return uses.groupBy("g", "reg", "version").agg(F.count("*").alias("n")).withColumn("single", F.col("n") == 1)


def type_union(facts: DataFrame, nil: str = "nil") -> DataFrame:
    """(g, types) of facts(g, pos, type): distinct types in first-seen order, joined by bars; nil last, nothing but nil is null.

    Types are reduced to their first place before they meet in one row, so a row holds the distinct types only.
    """
    first = facts.groupBy("g", "type").agg(F.min("pos").alias("pos"))
    parts = first.groupBy("g").agg(F.array_sort(F.collect_list(F.when(F.col("type") != nil, F.struct("pos", "type")))).alias("t"), F.bool_or(F.col("type") == nil).alias("nil"))
    names = F.transform("t", lambda e: e["type"])
    return parts.select("g", F.when(F.size("t") > 0, F.concat(F.array_join(names, "|"), F.when(F.col("nil"), "|" + nil).otherwise(""))).alias("types"))


def unique_owner(functions: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, owner) of names that exactly one row owns."""
    return functions.groupBy(name).agg(F.count("*").alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")


def block_stats(blocks: DataFrame) -> DataFrame:
    """(g, type, n)."""
    return blocks.groupBy("g", "type").agg(F.count("*").alias("n"))


def unit_summary(records: DataFrame, flagged: str, counted: str) -> DataFrame:
    """One row per graph of what its records hold: has_{flagged} tells whether that op occurs, n_{counted}s how often that one does."""
    return records.groupBy("g").agg(
        F.count("*").alias("n_records"), F.countDistinct("op").alias("n_ops"), F.max("reg").alias("max_reg"), F.countDistinct("reg").alias("n_regs"),
        F.bool_or(F.col("op") == flagged).alias(f"has_{flagged}"), F.count_if(F.col("op") == counted).alias(f"n_{counted}s"),
    )


def consumed_by(uses: DataFrame, by: Column) -> DataFrame:
    """(g, reg, version, consumed): whether any use of a version is one of by."""
    return uses.groupBy("g", "reg", "version").agg(F.bool_or(by).alias("consumed"))


def only_feeds(uses: DataFrame, tails: DataFrame) -> DataFrame:
    """(g, reg, version, only_tail): whether all uses of a version are block tails(g, pc)."""
    marked = uses.join(tails.select("g", "pc").distinct().withColumn("_tail", F.lit(True)), ["g", "pc"], "left")
    return marked.groupBy("g", "reg", "version").agg(F.bool_and(F.coalesce("_tail", F.lit(False))).alias("only_tail"))


def real_uses(uses: DataFrame, bookkeeping: Column, veto: Column) -> DataFrame:
    """(g, reg, version, n_real, vetoed): uses without bookkeeping ones, and whether any use disqualifies."""
    return uses.groupBy("g", "reg", "version").agg(F.count_if(~bookkeeping).alias("n_real"), F.bool_or(veto).alias("vetoed"))


def approved_sinks(uses: DataFrame, approved: Column) -> DataFrame:
    """(g, reg, version) of versions whose only use is one for which approved holds."""
    return uses.groupBy("g", "reg", "version").agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(approved, F.lit(False))).alias("_ok")).where("_n = 1 and _ok").select("g", "reg", "version")


def unit_facts(units: DataFrame) -> DataFrame:
    """units(g, n_params, n_captured, n_registers, variadic, types, is_main, version, types_version) with top_register, has_types and banner.

    types is the declared types' encoding, empty or null for none. The main unit's banner tells the versions, others
    have none.
    """
    banner = F.when(F.col("is_main"), F.format_string("version %d, types version %d", "version", "types_version"))
    return units.select(
        "g", "n_params", "n_captured", F.when(F.col("n_registers") > 0, F.col("n_registers") - 1).alias("top_register"), "variadic",
        (F.coalesce(F.length("types"), F.lit(0)) > 0).alias("has_types"), banner.alias("banner"),
    )


def self_overwrites(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(g, reg, version, overwritten): whether the record behind a use writes the same register."""
    writes = defs.select("g", "reg", (F.col("pc") - 1).alias("pc")).distinct().withColumn("_w", F.lit(True))
    return uses.join(writes, ["g", "reg", "pc"], "left").groupBy("g", "reg", "version").agg(F.bool_or(F.coalesce("_w", F.lit(False))).alias("overwritten"))
