"""The observation ledger as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import upserted


def first_observations(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each idempotency key once, as long as repeats come within ``late`` of it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_usage(events: DataFrame, user: str, at: str, units, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(user, start, used): units per user and window, closed once the watermark passes."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(user, F.window(at, length)).agg(F.sum(units).alias("used")).select(user, F.col("window.start").alias("start"), "used")


def user_sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, events) of sessions that end after a gap."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("events")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def upsert_into(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the newest row of each key, one full snapshot a batch.

    Snapshot ``batch=N`` is written from the one before it, so a batch that is run again
    after a failure writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}") if number else batch.limit(0)
        upserted(current, batch, keys, F.col(version)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
