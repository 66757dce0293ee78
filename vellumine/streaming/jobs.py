"""Streams: the state of jobs, and windows of their events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States in which a job has ended.
TERMINAL = ("completed", "completed_with_errors", "failed", "timed_out", "cancelled")


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 days", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, kind, n, total): events in tumbling windows; a window closes ``late`` after its end.

    The same for a stream and a table.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    windows = stamped.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return windows.select(F.col("window.start").alias("start"), kind, "n", "total")


def latest_states(events: DataFrame, job: str = "job_id", state: str = "state", time: str = "ts", order: str = "event_id") -> DataFrame:
    """(job, state, at, n_events, ended): each job's latest state; ties in time go by the event's id."""
    last = F.max(F.struct(time, order, state)).alias("last")
    made = events.groupBy(job).agg(last, F.count("*").alias("n_events"))
    return made.select(job, F.col(f"last.{state}").alias(state), F.col(f"last.{time}").alias("at"), "n_events", F.col(f"last.{state}").isin(*TERMINAL).alias("ended"))


def _reduced(events: DataFrame, job: str, state: str, time: str, order: str) -> DataFrame:
    return events.groupBy(job).agg(F.max(F.struct(time, order, state)).alias("last")).select(job, "last.*")


def keep_latest(stream: DataFrame, table: str, checkpoint: str, job: str = "job_id", state: str = "state", time: str = "ts", order: str = "event_id"):
    """A running query that keeps the latest state of each job in a Parquet table, batch by batch.

    Each batch is reduced to a row for a job and written as a part of its own,
    named after the batch: what a batch costs follows the batch, and one that
    runs again after a failure replaces its part. ``current_states`` reads
    the table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        _reduced(batch, job, state, time, order).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, table: str, job: str = "job_id", state: str = "state", time: str = "ts", order: str = "event_id") -> DataFrame:
    """(job, time, order, state): each job's latest state in a table of ``keep_latest``."""
    return _reduced(spark.read.parquet(table), job, state, time, order)


def compacted(spark: SparkSession, table: str, into: str, **columns: str) -> None:
    """The table's current states written as one batch of a new table, for one that has grown many."""
    current_states(spark, table, **columns).write.mode("overwrite").parquet(f"{into}/batch=0")
