"""Session settings that the engine's results depend on, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)

#: Results depend on these (time zone, recursion depth); sizes are left to the cluster.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "10001",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; sizing stays with the cluster's own configuration."""
    for key, value in RESULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table as a DataFrame; only Spark's readers touch the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Register the named tables (all when none are named) as temporary views."""
    for table in tables or TABLES:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
