"""Intermediate tables in the folder that all executors share.

Multi-pass operators write what several passes read, so that lineage is cut and a
lost executor never costs more than the stage at hand.
"""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import shared_root


class Scratch:
    """A folder of Parquet tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write a table and return it as read from there."""
        self.tables += 1
        path = f"{self.folder}/{self.tables:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads, and free the shuffle files of finished jobs."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files that no live DataFrame refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
