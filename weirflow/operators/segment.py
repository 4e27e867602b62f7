"""Windows over ordered records (g, pc, ...): blocks, versions, runs and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weirflow.plans.scan import HOT_ROWS, highest, lagged, latest, previous, running, total


def with_blocks(records: DataFrame, ends_block: Column, targets: DataFrame | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """records with b, the 0-based block: one begins at the first record, behind a record that ends a block, and at targets(g, pc).

    A record for which ends_block is null ends no block. A graph of more than hot records is cut into stretches.
    """
    target = F.lit(False)
    if targets is not None:
        marked = targets.select("g", "pc").distinct().withColumn("_target", F.lit(True))
        records = records.join(marked, ["g", "pc"], "left")
        target = F.coalesce("_target", F.lit(False))
    # A block begins behind every record that ends one, and at every target whose record before doesn't; the first is 0.
    ends = F.coalesce(ends_block, F.lit(False)).cast("long")
    if targets is None:
        out = running(records, ["g"], ["pc"], hot, b=total(ends, own=False))
        return out.withColumn("b", F.coalesce("b", F.lit(0).cast("long")))
    out = running(records.withColumn("_ends", ends), ["g"], ["pc"], hot, _before=previous(F.col("_ends")))
    leader = F.coalesce(F.col("_before.v") > 0, F.lit(True)) | target
    out = running(out.withColumn("_leader", leader.cast("long")), ["g"], ["pc"], hot, b=total(F.col("_leader")))
    return out.withColumn("b", F.col("b") - 1).drop("_leader", "_target", "_ends", "_before")


def assign_blocks(records: DataFrame, ends_block: Column, targets: DataFrame | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """(g, b, head_pc, tail_pc) of each block."""
    return with_blocks(records, ends_block, targets, hot).groupBy("g", "b").agg(F.min("pc").alias("head_pc"), F.max("pc").alias("tail_pc"))


def classify_blocks(blocked: DataFrame, terminators: dict[str, str], default: str = "FALL", offset: str | None = None, loop_ops: list[str] = (), hot: int = HOT_ROWS) -> DataFrame:
    """(g, b, terminator, type): the tail record's op by a map; a last block returns, one that its terminator ends breaks.

    With offset, a column of how far a tail record jumps, a block that jumps back continues. A block that jumps right
    before a record of loop_ops breaks or continues by the sign; other jumps are then LEAP.
    """
    tail = blocked.groupBy("g", "b").agg(F.max_by("op", "pc").alias("op"), *([F.max_by(offset, "pc").alias("_by")] if offset else []), F.min_by("op", "pc").alias("_first"))
    # the block behind is the one before when blocks are read from behind
    tail = running(tail.withColumn("_back", -F.col("b")), ["g"], ["_back"], hot, _behind=previous(F.col("_first")))
    last = F.col("_behind").isNull()
    chain = F.lit(default)
    for op, name in terminators.items():
        chain = F.when(F.col("op") == op, name).otherwise(chain)
    kind = F.lit("BREAK")
    if offset:
        kind = F.when(F.col("_by") < 0, "CONTINUE").otherwise("BREAK")
        kind = F.when(F.col("_behind.v").isin(*loop_ops), kind).otherwise("LEAP") if loop_ops else kind
    found = tail.withColumn("terminator", chain)
    return found.select("g", "b", "terminator", F.when(last, "RETURN").when(F.col("terminator") != default, kind).otherwise("STANDARD").alias("type"))


def decode_line_deltas(records: DataFrame, delta: str, gap: int, hot: int = HOT_ROWS) -> DataFrame:
    """(g, pc, line): the running sum of byte deltas modulo 256, plus the running base of the interval pc >> gap.

    The base of an interval grows by the last delta of each interval before it.
    """
    named = records.select("g", "pc", F.shiftright("pc", gap).alias("interval"), F.col(delta).alias("_delta"))
    rows = running(named, ["g"], ["pc"], hot, _sum=total(F.col("_delta")))
    steps = named.groupBy("g", "interval").agg(F.max_by("_delta", "pc").alias("step"))
    bases = running(steps, ["g"], ["interval"], hot, base=total(F.col("step"), own=False)).select("g", "interval", F.coalesce("base", F.lit(0)).alias("base"))
    return rows.join(bases, ["g", "interval"]).select("g", "pc", (F.pmod("_sum", F.lit(256)) + F.col("base")).alias("line"))


def number_versions(defs: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """defs(g, pc, reg) with version, from 1 per register; 0 is the value at the entry."""
    return running(defs, ["g", "reg"], ["pc"], hot, version=total(F.lit(1).cast("long")))


def high_water(records: DataFrame, anchor: Column, hot: int = HOT_ROWS) -> DataFrame:
    """(g, pc, span): at each anchor, the highest register mentioned before it minus its own; null where none was."""
    rows = running(records.select("g", "pc", "reg", anchor.alias("_is")), ["g"], ["pc"], hot, _most=highest(F.col("reg"), own=False))
    return rows.where("_is").select("g", "pc", (F.col("_most") - F.col("reg")).alias("span"))


def pair_with_previous(records: DataFrame, n: int, hot: int = HOT_ROWS) -> DataFrame:
    """(g, pc, paired_pc): records whose n-th predecessor has the same op and register."""
    rows = lagged(records.select("g", "pc", "op", "reg"), ["g"], ["pc"], n, {"paired_pc": F.col("pc"), "_op": F.col("op"), "_reg": F.col("reg")}, hot)
    return rows.where("_op = op and _reg = reg").select("g", "pc", "paired_pc")


def trailing_run(records: DataFrame, anchor: str, op: str, hot: int = HOT_ROWS) -> DataFrame:
    """(g, anchor_pc, pc, ord): the unbroken run of op records directly behind each anchor, numbered from 0."""
    other = F.when(F.col("op") != op, F.struct("pc", "op"))
    rows = running(records.select("g", "pc", "op"), ["g"], ["pc"], hot, _other=latest(other))
    rows = rows.where((F.col("op") == op) & (F.col("_other.op") == anchor)).select("g", F.col("_other.pc").alias("anchor_pc"), "pc")
    return rows.withColumn("ord", F.col("pc") - F.col("anchor_pc") - 1)


def collect_until_barrier(
    records: DataFrame, anchor: Column, wanted: Column, barrier: Column, limit: int = 100, redefines: Column | None = None, foldable: Column | None = None, hot: int = HOT_ROWS
) -> DataFrame:
    """(g, anchor_pc, n, pcs): wanted records behind each anchor, up to limit places and before the first barrier.

    A record for which redefines holds is a barrier to anchors of the same reg. If foldable does not hold for one of the
    records found, the anchor gets none. Records meet anchors by stretches of limit places, so lists are made for
    anchors only.
    """
    place = F.floor(F.col("pc") / limit)
    rows = records.select("g", "pc", (-F.col("pc")).alias("_back"), "reg", anchor.alias("_a"), barrier.alias("_bars"), (redefines if redefines is not None else F.lit(False)).alias("_re"))
    # the next barrier, or redefinition, is the last one seen when the records are read from behind
    rows = running(rows, ["g"], ["_back"], hot, _stop=latest(F.when(F.col("_bars"), F.col("pc")), own=False))
    if redefines is None:
        rows = rows.withColumn("_again", F.lit(None).cast("long"))
    else:
        rows = running(rows, ["g", "reg"], ["_back"], hot, _again=latest(F.when(F.col("_re"), F.col("pc")), own=False))
    anchors = rows.where("_a").select("g", F.col("pc").alias("anchor_pc"), F.least("_stop", "_again").alias("_stop"))
    stretches = F.floor(F.col("anchor_pc") / limit)
    looking = anchors.withColumn("_stretch", F.explode(F.array(stretches, stretches + 1)))
    found = records.where(wanted).select("g", "pc", place.alias("_stretch"), (foldable if foldable is not None else F.lit(True)).alias("_ok"))
    hits = looking.join(found, ["g", "_stretch"]).where(f"pc > anchor_pc and pc <= anchor_pc + {limit} and (_stop is null or pc < _stop)")
    lists = hits.groupBy("g", "anchor_pc").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_ok"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("pc")), lambda p: p.cast("string")), ",").alias("pcs"))
    return anchors.select("g", "anchor_pc").join(lists.where("_ok"), ["g", "anchor_pc"], "left").select("g", "anchor_pc", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("pcs", F.lit("")).alias("pcs"))


def fallthrough(blocks: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(g, b, next_b): the next block in order, null for the last."""
    rows = running(blocks.select("g", "b", (-F.col("b")).alias("_back")), ["g"], ["_back"], hot, _behind=previous(F.col("b")))
    return rows.select("g", "b", F.col("_behind.v").alias("next_b"))


def first_write(defs: DataFrame, params: DataFrame | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """(g, pc, reg, declares): whether a write is the register's first in its graph. A register of params(g, reg) is declared at the entry, so never later."""
    rows = number_versions(defs.select("g", "pc", "reg"), hot).select("g", "pc", "reg", (F.col("version") == 1).alias("declares"))
    if params is None:
        return rows
    given = params.select("g", "reg").distinct().withColumn("_given", F.lit(True))
    return rows.join(given, ["g", "reg"], "left").select("g", "pc", "reg", (F.col("declares") & F.col("_given").isNull()).alias("declares"))
