"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only for a local master without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that one task of a shuffle is dealt.
ROWS_A_TASK = 1_000_000


def tasks_for(df: DataFrame) -> int:
    """Tasks among which rows are dealt, so that a task's memory does not grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


class Stored:
    """Tables written one after the other, of which those no longer read can go.

    ``keep(df)`` writes and rereads a table, which cuts its lineage: a lost executor
    costs a reread. ``drop(but)`` deletes the tables that this object wrote before the
    last ``but`` of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: int = 1) -> None:
        gone, self.paths = (self.paths[:-but], self.paths[-but:]) if but else (self.paths, [])
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """One table, written and reread."""
    return Stored(df.sparkSession, name).keep(df)
