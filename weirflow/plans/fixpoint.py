"""Set-based fixpoints: rounds of joins over the newest rows only, for all graphs at once."""

from __future__ import annotations

import functools
import itertools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Rows above which a settled table is joined by shuffles: its files are a small part of what its rows take in memory.
SHUFFLED_ROWS = 100_000

#: The folder behind each settled table and its rows, and the folders written in each open scratch() of a thread.
_folder_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_rows_of: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()
_opened: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, which the scratch() around it deletes."""
    path = f"{shared_folder(spark)}/weirflow-{name}-{uuid.uuid4().hex}"
    for mine in _opened.get()[-1:]:
        mine.append(path)
    return path


def shuffled(df: DataFrame) -> DataFrame:
    """The table, joined by shuffles. Spark goes by the size of files, which packs rows up to a hundredfold, and would send them all through the driver.

    A union or a join hides what its tables say of themselves, so it has to be said of the outcome.
    """
    return df.hint("merge")


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """The table, written once into the shared folder: later rounds neither repeat its plan nor lose it with an executor."""
    path, seen = own_folder(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out, rows = df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
    out = _told(out, rows)
    _folder_of[out] = path
    return out


def _told(df: DataFrame, rows: int) -> DataFrame:
    out = shuffled(df) if rows > SHUFFLED_ROWS else df
    _rows_of[out] = rows
    return out


def together(*tables: DataFrame) -> DataFrame:
    """The rows of settled tables as one; joined by shuffles if they are many."""
    return _told(functools.reduce(DataFrame.unionByName, tables), sum(_rows_of[t] for t in tables))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of settled tables whose rows are settled elsewhere by now; other tables are left alone."""
    for df in tables:
        path = _folder_of.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes all tables settled inside when it ends, but for those handed to the function that it gives.

    A query's result reads its settled tables, so write the result inside:
    with scratch(spark): query(spark, folder).write.parquet(out).
    """
    mine: list[str] = []
    kept: list[str] = []
    before = _opened.get()
    _opened.set((*before, mine))

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_folder_of[df])
        return df

    try:
        yield keep
    finally:
        _opened.set(before)
        for outer in before[-1:]:
            outer.extend(kept)
        for path in mine:
            if path not in kept:
                _delete(spark, path)


def grow(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int | None = None, gather: int = 16) -> DataFrame:
    """The least set that holds seed and all that step(newest, all so far) derives from it.

    Rows are compared as wholes. Each round joins only the rows that the last one added. The parts are gathered into
    one table every so many rounds, and their folders deleted. A set that can't grow without end settles whatever
    its depth; for others most_rounds is a bound beyond which the search raises. Nothing is cut off.
    """
    newest = settled(seed.distinct())
    known, parts = newest, [newest]
    for done in itertools.count(1):
        if most_rounds is not None and done > most_rounds:
            raise RuntimeError(f"the fixpoint still grows after {most_rounds} rounds")
        newest = settled(step(newest, known).distinct().join(known, seed.columns, "left_anti"))
        if newest.isEmpty():
            discard(newest)
            return known
        known = together(known, newest)
        parts.append(newest)
        if not done % gather:
            known = settled(known)
            discard(*parts[:-1])
            parts = [newest, known]
    raise AssertionError


def jump(links: DataFrame, cycle_end: Callable[..., Column] = F.least) -> DataFrame:
    """(g, node, top, steps): the end of each node's chain of links(g, node, next), by pointer jumping.

    A node without a link, or with one to itself, is its own end. Each round doubles the steps seen, so a chain of n
    links takes log n rounds. Where a chain leads into a cycle, the end is the cycle's smallest node, or with F.greatest
    its largest, and steps is null.
    """
    links = settled(links.select("g", "node", "next").where("node <> next"))
    nodes = links.select("g", "node").union(links.select("g", F.col("next").alias("node"))).distinct()
    first = F.coalesce("next", "node")
    linked = F.col("next").isNotNull()
    newest = settled(nodes.join(links, ["g", "node"], "left").select("g", "node", first.alias("top"), linked.cast("long").alias("steps"), cycle_end("node", "next").alias("end"), linked.alias("linked"), linked.alias("moved"), F.lit(False).alias("circle")))
    columns, total = newest.columns, _rows_of[newest]
    most = newest.groupBy("g").count().agg(F.max("count")).first()[0] or 1
    # A top that is its own top stays, so what leads there has its end and isn't asked again.
    resting = [newest.where("not moved")]
    for _ in range(most.bit_length() + 1):
        state = _told(functools.reduce(DataFrame.unionByName, [*resting, newest.where("moved")]), total)
        ahead = state.select("g", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"), F.col("end").alias("_end"), F.col("linked").alias("_linked"))
        asking = newest.where("moved")
        if _rows_of[newest] <= SHUFFLED_ROWS:
            asking = F.broadcast(asking)  # the last few of many chains
        following = asking.join(ahead, ["g", "top"]).select(
            "g", "node", F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), cycle_end("end", "_end").alias("end"), "linked", (F.col("top") != F.col("_top")).alias("moved"), F.col("_linked").alias("circle")
        )
        newest = settled(following.select(*columns))
        resting.append(newest.where("not moved"))
        if newest.where("moved").isEmpty():
            break
    # What still moves goes round a circle, and so does a top that leads on; by now the end that each node there has seen is that of the whole circle.
    ended = functools.reduce(DataFrame.unionByName, resting)
    around = ended.where("circle").unionByName(newest.where("moved"))
    ends = around.select("g", F.col("node").alias("top"), F.col("end").alias("_on_cycle"))
    there = around.join(ends, ["g", "top"]).select("g", "node", F.col("_on_cycle").alias("top"), F.lit(None).cast("long").alias("steps"))
    return _told(ended.where("not circle").select("g", "node", "top", "steps").unionByName(there), total)
