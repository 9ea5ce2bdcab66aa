"""Cutting the lineage of loops: tables written in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where a session of one machine names none, as in tests, one of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet and read back: later steps start from files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files of steps that are done: the driver does so as it collects its garbage, which may be never in a run of minutes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` for work on each row: written over all cores, dealt by ``by``, where its scan gives fewer tasks than there are cores, else as it is.

    What is written is bounded: so few tasks read little. But few bytes may be many rows, or short ones that expressions make long.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return stored(df.repartition(4 * cores, *by), "spread")


class Levels:
    """A table that grows by levels: each is written once, into a folder of its own, and all are read as one table."""

    def __init__(self, first: DataFrame, name: str = "levels"):
        self.spark, self.schema, self.n = first.sparkSession, first.schema, 0
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.last = self.append(first)

    def append(self, df: DataFrame) -> DataFrame:
        """Write the next level; returns it as read back."""
        where = f"{self.path}/level={self.n}"
        df.select(*self.schema.names).write.parquet(where)
        self.n += 1
        self.last = self.spark.read.schema(self.schema).parquet(where)
        return self.last

    def table(self) -> DataFrame:
        """Everything so far."""
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/level=*")
