"""Tables in the cluster's shared folder that cut lineage between the steps of an operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a local one only for a local master, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = os.path.join(tempfile.gettempdir(), "corpusloom-work")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def merging(df: DataFrame) -> DataFrame:
    """One side of a join whose sides both grow with the input: they are sorted and merged, so that neither goes whole through the driver.

    Without this Spark broadcasts work tables by the size of their files, which is far below
    that of their rows where these compress well.
    """
    return df.hint("merge")


class WorkTable:
    """A table written to the shared folder, which cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = work_dir(self.spark)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; call it only once nothing lazy reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
