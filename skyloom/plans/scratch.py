"""Scratch tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set in local mode (tests), a new one. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if found.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyloom-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get()
    return path.rstrip("/")


class Scratch:
    """A folder of tables for one job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/skyloom-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table and returns a reader of it."""
        df.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that later steps no longer read."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
