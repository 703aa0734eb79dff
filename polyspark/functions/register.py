"""SQL-callable twins: user functions of five plain types, and the engine's own functions by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.document import json_contains_series
from ..operators.geo import EARTH_M
from ..operators.timeseries import interval_ms

TYPES = {"int8": "bigint", "float8": "double", "bool": "boolean", "float8[]": "array<double>", "bytea": "binary"}


def create_function(spark: SparkSession, name: str, returns: str, body: Callable) -> None:
    """A scalar function over pandas columns: ``body`` gets a Series for each argument and returns one."""
    spark.udf.register(name, F.pandas_udf(body, TYPES[returns]))


def register_all(spark: SparkSession) -> list[str]:
    """The engine's functions as temporary SQL functions: expressions wherever SQL can hold them, so Catalyst sees through."""
    made = {
        "time_bucket_ms": "(size BIGINT, ts BIGINT) RETURNS BIGINT RETURN ts - pmod(ts, size)",
        "dot_product": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
        "l2_distance": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))",
        "cosine_similarity": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)",
        "vector_dims": "(a ARRAY<DOUBLE>) RETURNS INT RETURN size(a)",
        "haversine_m": f"(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN 2 * {EARTH_M} * asin(sqrt(least(1D, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))",
        "json_valid": "(j STRING) RETURNS BOOLEAN RETURN j IS NULL OR try_parse_json(j) IS NOT NULL",
        "json_get": "(j STRING, path STRING) RETURNS STRING RETURN get_json_object(j, path)",
    }
    for name, text in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")

    @F.pandas_udf("bigint")
    def bucket(interval: pd.Series, ts: pd.Series) -> pd.Series:
        size = interval.map(interval_ms)
        return ts - ts % size

    spark.udf.register("time_bucket", bucket)
    spark.udf.register("json_contains", F.pandas_udf(json_contains_series, "boolean"))
    return [*made, "time_bucket", "json_contains"]
