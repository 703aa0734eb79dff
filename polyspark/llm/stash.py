"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage here: a table is written once, in Parquet, under ``spark.checkpoint.dir`` and read
back, so that a lost executor costs a re-read and never a recomputation of the whole history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; where none is named, one beside the warehouse, which all executors can reach."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stash:
    """Tables of one operator run. ``put`` writes and rereads; ``drop`` removes what later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
