"""Tables between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; where none is named, one beside the warehouse, which all executors can reach."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once and read back: its plan is short, and a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds consecutive numbers from 0 in each group, by ``order``, without gathering a group in one task: rows are ranged by
    group and order, numbered within each range, and shifted by what the ranges before hold (one row for each range and group)."""
    parts = df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id())
    parts = stored(parts, "numbered")
    own = Window.partitionBy("_p", *group).orderBy(*order)
    sizes = parts.groupBy("_p", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["_p", *group]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    rows = parts.withColumn("_i", F.row_number().over(own) - 1)
    return rows.alias("a").join(sizes.alias("b"), on).select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a._i") + F.col("b._before")).cast("long").alias(out))
