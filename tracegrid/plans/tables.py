"""Intermediate tables in the folder that all executors share.

Operators that read a result several times, or go on from it level by level, write it there. So
lineage is cut and a lost executor never costs more than the stage at hand.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a
    temporary folder; on a cluster that is an error, as executors would not see the tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Tables:
    """A folder of Parquet tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write a table and return it as read from there."""
        self.count += 1
        path = f"{self.folder}/{self.count:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
