"""Catalog relations of tables, columns, types, indexes and constraints, computed from Spark's catalog and declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import information_schema_columns, information_schema_tables, pg_attribute, pg_class, pg_tables

#: Type ids that clients expect.
TYPE_IDS = {"boolean": 16, "binary": 17, "bigint": 20, "smallint": 21, "int": 23, "string": 25, "float": 700, "double": 701, "date": 1082, "timestamp_ntz": 1114, "timestamp": 1184, "decimal": 1700}


def pg_namespace(spark: SparkSession) -> DataFrame:
    rows = [(2200 + i, d.name) for i, d in enumerate(spark.catalog.listDatabases())]
    return spark.createDataFrame(rows, "oid long, nspname string")


def pg_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for n, i in TYPE_IDS.items()], "oid long, typname string")


def pg_am(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(("btree", "spatial", "time", "graph", "jsonpath", "fts", "vector", "ivf"), 1)], "oid long, amname string")


def pg_indexes(spark: SparkSession, tables=()) -> DataFrame:
    rows = [(t.name, i.name, f"{i.method} ({', '.join(i.columns)})") for t in tables for i in t.indexes.values()]
    return spark.createDataFrame(rows, "tablename string, indexname string, indexdef string")


def pg_index(spark: SparkSession, tables=()) -> DataFrame:
    return pg_indexes(spark, tables).select(F.abs(F.xxhash64("indexname")).alias("indexrelid"), F.abs(F.xxhash64("tablename")).alias("indrelid"))


def pg_constraint(spark: SparkSession, tables=()) -> DataFrame:
    rows = []
    for t in tables:
        rows += [(t.name, "p", ",".join(t.primary_key), None)] * bool(t.primary_key)
        rows += [(t.name, "u", ",".join(u), None) for u in t.unique]
        rows += [(t.name, "f", f.column, f.parent.name) for f in t.foreign_keys]
    return spark.createDataFrame(rows, "conrelname string, contype string, columns string, confrelname string")


def pg_sequence(spark: SparkSession, sequences: dict | None = None) -> DataFrame:
    rows = [(n, s.start, s.step, s.value if s.started else None) for n, s in (sequences or {}).items()]
    return spark.createDataFrame(rows, "seqname string, seqstart long, seqincrement long, last_value long")


def pg_roles(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(10).cast("long").alias("oid"), F.current_user().alias("rolname"), F.lit(True).alias("rolcanlogin"))


def pg_auth_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "roleid long, member long")


def register_views(spark: SparkSession, tables=(), sequences: dict | None = None) -> list[str]:
    """All catalog relations as temporary views under their own names."""
    made = {
        "pg_tables": pg_tables(spark), "pg_class": pg_class(spark), "pg_attribute": pg_attribute(spark), "pg_namespace": pg_namespace(spark), "pg_type": pg_type(spark), "pg_am": pg_am(spark),
        "pg_indexes": pg_indexes(spark, tables), "pg_index": pg_index(spark, tables), "pg_constraint": pg_constraint(spark, tables), "pg_sequence": pg_sequence(spark, sequences),
        "pg_roles": pg_roles(spark), "pg_auth_members": pg_auth_members(spark), "information_schema_tables": information_schema_tables(spark), "information_schema_columns": information_schema_columns(spark),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
