"""Tools for a caller that explores data: table list, columns, schema with value histograms, plans, and read-only queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import value_histogram
from .sqlfront import sql

#: Tables of more rows get no histograms.
HISTOGRAM_ROWS = 10_000


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def list_columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def schema(spark: SparkSession, table: str) -> dict:
    """Columns with types and, for small tables, the ten most frequent values of each."""
    df = spark.table(table)
    small = df.limit(HISTOGRAM_ROWS + 1).count() <= HISTOGRAM_ROWS
    return {c: {"type": t, "top": [tuple(r) for r in value_histogram(df, c).collect()] if small else None} for c, t in df.dtypes}


def query(spark: SparkSession, text: str, args: list | None = None, limit: int = 1000) -> list[dict]:
    """Rows of a statement that reads; anything else is refused."""
    if text.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH", "MATCH", "VALUES", "SHOW", "DESCRIBE"):
        raise ValueError("only statements that read")
    return [r.asDict(recursive=True) for r in sql(spark, text, args).limit(limit).collect()]


def explain(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
