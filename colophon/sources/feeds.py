"""Imports: feeds in order, each by itself, resumed from where the last run got to."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Stored


class FeedResult(NamedTuple):
    """What became of a feed: its rows, or why it failed."""

    feed: str
    rows: int
    error: str | None


def run_feeds(feeds: dict[str, Callable[[], int]]) -> tuple[list[FeedResult], int]:
    """Run feeds in order and return their results and the total of rows.

    A feed that fails is reported and does not keep the others from running.
    """
    results = []
    for name, feed in feeds.items():
        try:
            results.append(FeedResult(name, feed(), None))
        except Exception as e:
            results.append(FeedResult(name, 0, f"{type(e).__name__}: {e}"))
    return results, sum(r.rows for r in results)


def import_from(records: DataFrame, key: str, folder: str, job: str, write: Callable[[DataFrame], None], limit: int | None = None) -> int:
    """Hand on the records whose ``key`` is above the job's watermark, and move it; rows handed on.

    The watermark is a table of one row a run below ``folder``; it moves only after
    ``write`` has ended, so a run that fails is done again from the same place. ``limit``
    takes the first so many records, and all others of the last one's key: a run
    never ends within a key. The slice is stored once, so what is written is what was
    counted. Records with a null key come before all others and are part of the first run alone.
    """
    spark: SparkSession = records.sparkSession
    schema = f"job string, at {records.schema[key].dataType.simpleString()}"
    path = f"{folder}/watermarks"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema(schema).parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else spark.createDataFrame([], schema)
    last, runs = known.where(F.col("job") == job).agg(F.max("at"), F.count("*")).first()
    new = records if not runs else records.where(F.col(key).isNotNull()) if last is None else records.where(F.col(key) > F.lit(last))
    if limit is not None:
        keys = new.select(key).orderBy(F.col(key).asc_nulls_first()).limit(limit).agg(F.max(key), F.count("*")).first()
        new = new.where(F.col(key).isNull() | (F.col(key) <= F.lit(keys[0]))) if keys[1] and keys[0] is not None else new.where(F.col(key).isNull()) if keys[1] else new.limit(0)
    table = Stored(spark, "slice")
    whole = table.keep(new)
    reached = whole.agg(F.max(key).alias("at"), F.count("*").alias("n")).first()
    if reached["n"]:
        write(whole)
        spark.createDataFrame([(job, reached["at"])], schema).write.mode("append").parquet(path)
    table.drop(0)
    return reached["n"]


def missing_runs(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """(record, missing): in how many of the last runs (run), one after the other, a record was not seen.

    ``seen``: record, run. Runs are ordered; a record of the last run is missing 0 times.
    """
    last = seen.groupBy("record").agg(F.max("run").alias("last"))
    after = runs.select("run").distinct().withColumn("after", F.count("*").over(_later()) - 1)
    return last.join(after, F.col("last") == F.col("run")).select("record", F.col("after").alias("missing"))


def _later():
    from pyspark.sql import Window

    # There are few runs, one row each.
    return Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, 0)
