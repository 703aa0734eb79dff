"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import domain, relational, wider


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue by event type: scan, bucket, aggregate, having, sort."""
    day = 86_400_000
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return (
        load(spark, sf_dir, "events")
        .select((ms - F.pmod(ms, F.lit(day))).alias("bucket"), "event_type", "value")
        .groupBy("bucket", "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .where("n > 1")
        .orderBy("bucket", "event_type")
    )


FLAGSHIP_SQL = """
SELECT bucket, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 86400000 AS bucket, event_type, value FROM events)
GROUP BY bucket, event_type HAVING count(*) > 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"daily_revenue": flagship} | relational.QUERIES | domain.QUERIES | wider.QUERIES
ORACLE_SQL: dict[str, str] = {"daily_revenue": FLAGSHIP_SQL} | relational.ORACLE_SQL | domain.ORACLE_SQL | wider.ORACLE_SQL
