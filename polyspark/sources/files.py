"""Readers and writers: tab text with \\N nulls, CSV, JSON arrays, Parquet, JDBC with type maps, and catalog views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_copy(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated text; ``\\N`` is null and backslash escapes stand for tab, newline, return and backslash.

    The fields are split natively; an escaped newline is two characters in the file, so a line is always a row.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    raw = spark.read.text(path)
    parts = F.split("value", "\t", -1)

    def field(i: int):
        def plain(v):
            for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
                v = F.replace(v, F.lit(code), F.lit(char))
            return v

        # Between escaped backslashes every backslash begins another escape.
        pieces = F.split(F.get(parts, F.lit(i)), r"\\\\", -1)
        return F.when(F.get(parts, F.lit(i)) != "\\N", F.array_join(F.transform(pieces, plain), "\\"))

    return raw.select(*(field(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))


def write_copy(df: DataFrame, path: str, mode: str = "error") -> None:
    """The same text from any DataFrame, one file for each partition."""

    def field(c: str):
        v = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            v = F.replace(v, F.lit(char), F.lit(code))
        return F.coalesce(v, F.lit("\\N"))

    df.select(F.concat_ws("\t", *(field(c) for c in df.columns)).alias("value")).write.mode(mode).text(path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A header row and double quotes, which may hold line ends."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Files with a JSON array of flat objects each, or with one object a line; the first line that is not blank tells which."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    reader = spark.read.option("multiLine", bool(first) and first.value.lstrip().startswith("["))
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def as_text_table(df: DataFrame, limit: int = 100) -> str:
    """The first rows as a plain table with borders."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    size = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = "+" + "+".join("-" * (n + 2) for n in size) + "+"
    show = lambda r: "|" + "|".join(f" {v:<{n}} " for v, n in zip(r, size)) + "|"
    return "\n".join([line, show(df.columns), line, *map(show, rows), line])


#: Types of other systems by the type that a column gets here; any name that is missing becomes a string.
TYPE_MAPS = {
    "postgres": {"int2": "smallint", "smallint": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "bigint": "bigint", "float4": "float", "real": "float", "float8": "double", "double precision": "double", "numeric": "decimal(38,10)", "bool": "boolean", "boolean": "boolean", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp"},
    "mysql": {"tinyint": "smallint", "smallint": "smallint", "mediumint": "int", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "decimal": "decimal(38,10)", "bit": "boolean", "blob": "binary", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp"},
    "mssql": {"tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "real": "float", "float": "double", "money": "decimal(19,4)", "bit": "boolean", "varbinary": "binary", "date": "date", "datetime2": "timestamp_ntz", "datetimeoffset": "timestamp"},
    "oracle": {"number": "decimal(38,10)", "binary_float": "float", "binary_double": "double", "raw": "binary", "blob": "binary", "date": "timestamp_ntz", "timestamp": "timestamp_ntz"},
    "mongodb": {"int": "int", "long": "bigint", "double": "double", "bool": "boolean", "date": "timestamp", "bindata": "binary"},
    "elasticsearch": {"byte": "smallint", "short": "smallint", "integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "timestamp", "dense_vector": "array<float>"},
    "influxdb": {"integer": "bigint", "float": "double", "boolean": "boolean", "time": "timestamp"},
    "neo4j": {"integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"},
    "kafka": {"int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "boolean": "boolean", "bytes": "binary"},
}


#: Types of the standard numeric codes that ODBC catalogs give.
ODBC_TYPES = {2: "decimal(38,10)", 3: "decimal(38,10)", 4: "int", 5: "smallint", -6: "smallint", -5: "bigint", 7: "float", 6: "double", 8: "double", -7: "boolean", -2: "binary", -3: "binary", -4: "binary", 91: "date", 9: "timestamp", 93: "timestamp"}


def map_type(system: str, name: str | int) -> str:
    """The type here of a type there. Some systems have a meaning for a width (MySQL's tinyint(1)) or an unsigned prefix."""
    if system == "odbc":
        return ODBC_TYPES.get(int(name), "string")
    name = name.lower().strip()
    if system == "mysql" and name == "tinyint(1)":
        return "boolean"
    if system == "postgis":
        if name in ("geometry", "geography", "geometry_dump"):
            return "string"  # well-known text
        system = "postgres"
    return TYPE_MAPS[system].get(name.split("(")[0].strip().removeprefix("unsigned ").removeprefix("_"), "string")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options) -> DataFrame:
    """A table by JDBC, cut into ranges of a numeric key so that no one connection reads it all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def migrate(source: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Snapshot to Parquet, read it back and return the rows that differ (none when all is well)."""
    from ..operators.tables import verify_copy

    source.write.mode("overwrite").parquet(path)
    return verify_copy(source, source.sparkSession.read.schema(source.schema).parquet(path), keys)


def information_schema_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.namespace[0] if t.namespace else None, t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def information_schema_columns(spark: SparkSession) -> DataFrame:
    rows = [(t.name, c.name, i + 1, "YES" if c.nullable else "NO", c.dataType) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def pg_tables(spark: SparkSession) -> DataFrame:
    return information_schema_tables(spark).select(F.coalesce("table_schema", F.lit("public")).alias("schemaname"), F.col("table_name").alias("tablename"))


def pg_class(spark: SparkSession) -> DataFrame:
    kind = F.when(F.col("table_type") == "VIEW", "v").otherwise("r")
    return information_schema_tables(spark).select(F.abs(F.xxhash64("table_name")).alias("oid"), F.col("table_name").alias("relname"), kind.alias("relkind"))


def pg_attribute(spark: SparkSession) -> DataFrame:
    return information_schema_columns(spark).select(F.abs(F.xxhash64("table_name")).alias("attrelid"), F.col("column_name").alias("attname"), F.col("ordinal_position").alias("attnum"), (F.col("is_nullable") == "NO").alias("attnotnull"))
