"""Continuous ingest: each row decoded by itself, then answered or quarantined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def judged(stream: DataFrame, payload: str, field: str = "$.k") -> DataFrame:
    """stream with k and status: ok where the payload is JSON with an integer at field, else damaged."""
    return stream.withColumn("k", F.get_json_object(payload, field).try_cast("long")).withColumn("status", F.when(F.col("k").isNotNull(), "ok").otherwise("damaged"))


def once(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """stream without repeated requests: of rows equal in keys that come within an interval of event time at, the first stays.

    The keys seen are state, kept until the watermark, the latest time seen less the interval, has passed them; so the
    state is as large as the requests of one interval, whatever the stream's length. Rows that come later than that
    are left out, as it can't be told any more whether they were answered.
    """
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def stream_ingest(stream: DataFrame, judge: str | Callable[[DataFrame], DataFrame], good: str, failed: str, checkpoint: str) -> StreamingQuery:
    """Append good rows to one Parquet folder and failed rows to another, for all that is there, then stop.

    judge gives rows their status, ok or another, by any of the decoders that work row by row; a name is short for
    judged() on that column. A batch that is repeated after a failure overwrites its own part of both folders, so no
    row comes twice.
    """
    told = judged(stream, judge) if isinstance(judge, str) else judge(stream)

    def both(batch: DataFrame, number: int) -> None:
        batch.where("status = 'ok'").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("status is null or status <> 'ok'").write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return told.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
