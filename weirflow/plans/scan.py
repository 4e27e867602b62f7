"""Running values over ordered rows whose groups may be of any size: stretches of the order, and what is carried over between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weirflow.plans.fixpoint import settled

#: Rows of a group above which it is cut into stretches.
HOT_ROWS = 1_000_000


class Running:
    """A value that runs along an order: how a window gathers it, what a whole part of the order comes to, and how the two join."""

    def __init__(self, gather, whole, join, of: Column, own: bool) -> None:
        self.gather, self.whole, self.join, self.of, self.own = gather, whole, join, of, own


def total(of: Column, own: bool = True) -> Running:
    """The sum so far, the row's own value with it or not; null before any value."""
    return Running(F.sum, lambda c, _: F.sum(c), lambda before, here: F.coalesce(before + here, before, here), of, own)


def highest(of: Column, own: bool = True) -> Running:
    return Running(F.max, lambda c, _: F.max(c), F.greatest, of, own)


def latest(of: Column, own: bool = True) -> Running:
    """The last value so far that is not null."""
    return Running(lambda c: F.last(c, ignorenulls=True), lambda c, place: F.max_by(c, F.when(c.isNotNull(), place)), lambda before, here: F.coalesce(here, before), of, own)


def previous(of: Column) -> Running:
    """A struct with the value v of the row before, null in the first row."""
    return latest(F.struct(of.alias("v")), own=False)


def running(rows: DataFrame, keys: list[str], order: list[str], hot: int = HOT_ROWS, **values: Running) -> DataFrame:
    """rows with a column for each of the values, running along order within each group of keys.

    order, with keys, tells all rows apart that matter; equal ones are in any order, as in a window. A group of more
    than hot rows isn't one task's work: its rows are dealt over stretches of the order, each stretch runs by itself,
    and what those before it add up to is carried into it. Null keys are a group.
    """
    cold, found = _split(rows, keys, hot)
    if found is None:
        return _windowed(rows, keys, order, values)
    same = lambda other: [F.col(f"l.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
    dealt = settled(found.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "stretches")
    hot_rows = _windowed(dealt, [*keys, "_part"], order, values)
    wholes = dealt.groupBy(*keys, "_part").agg(*(v.whole(v.of, F.struct(*order)).alias(f"_{n}") for n, v in values.items()))
    parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = settled(wholes.select(*keys, "_part", *(v.gather(F.col(f"_{n}")).over(parts).alias(f"_{n}") for n, v in values.items())))
    # One row per stretch, as many as there are tasks.
    met = hot_rows.alias("l").join(F.broadcast(carried.alias("c")), [*same("c"), F.col("l._part") == F.col("c._part")], "left")
    out = met.select(*(F.col(f"l.{c}") for c in rows.columns), *(v.join(F.col(f"c._{n}"), F.col(f"l.{n}")).alias(n) for n, v in values.items()))
    return _windowed(cold, keys, order, values).unionByName(out)


def lagged(rows: DataFrame, keys: list[str], order: list[str], n: int, values: dict[str, Column], hot: int = HOT_ROWS) -> DataFrame:
    """rows with values of the n-th row before in order within each group of keys, null where there is none.

    Rows of a group of more than hot rows are numbered over stretches, and meet by group and number.
    """
    cold, found = _split(rows, keys, hot)
    window = Window.partitionBy(*keys).orderBy(*order)
    near = cold.select(*rows.columns, *(F.lag(v, n).over(window).alias(name) for name, v in values.items()))
    if found is None:
        return near
    numbered = settled(running(found, keys, order, hot, _place=total(F.lit(1).cast("long"))))
    before = numbered.select(*keys, (F.col("_place") + n).alias("_place"), *(v.alias(name) for name, v in values.items()))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_place"]]
    met = numbered.alias("l").join(before.alias("b"), same, "left")
    return near.unionByName(met.select(*(F.col(f"l.{c}") for c in rows.columns), *(F.col(f"b.{name}") for name in values)))


def _split(rows: DataFrame, keys: list[str], hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to hot rows, and those of larger ones, None where there are none."""
    large = rows.groupBy(*keys).count().where(F.col("count") > hot).select(*keys)  # at most one group for every hot rows
    if large.isEmpty():
        return rows, None
    large = settled(large)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return tuple(rows.alias("l").join(large.alias("h"), same, how) for how in ("left_anti", "left_semi"))


def _windowed(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    sorted_ = Window.partitionBy(*keys).orderBy(*order)
    whole, before = sorted_.rowsBetween(Window.unboundedPreceding, 0), sorted_.rowsBetween(Window.unboundedPreceding, -1)
    named = rows.select("*", *(v.of.alias(f"__{n}") for n, v in values.items()))
    return named.select(*rows.columns, *(v.gather(F.col(f"__{n}")).over(whole if v.own else before).alias(n) for n, v in values.items()))
