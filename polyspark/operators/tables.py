"""Constraints, upserts, checksums, statistics and histograms of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import numbered, stored


def upsert(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest sequence of each key, as a grouped maximum (combined on the map side)."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(rows.columns)


def update_where(df: DataFrame, condition, **values) -> DataFrame:
    """SET on the rows that the condition holds for; expressions see the old row."""
    hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    new = {c: F.when(hit, F.expr(v) if isinstance(v, str) else v).otherwise(F.col(c)) for c, v in values.items()}
    return df.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))


def delete_where(df: DataFrame, condition) -> DataFrame:
    return df.where(~F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False)))


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    return df.withColumn(name, F.lit(default).cast(kind))


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.greatest(*(F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 1)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once; a key with a null is exempt."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fk_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def row_checksums(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, checksum) over all columns in order."""
    return df.select(*keys, F.xxhash64(*(F.col(c) for c in df.columns)).alias("checksum"))


def verify_copy(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ: (keys, problem) with problem missing, extra or changed."""
    a = row_checksums(source, keys).withColumnRenamed("checksum", "_a")
    b = row_checksums(target, keys).withColumnRenamed("checksum", "_b")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, keys, "full_outer").select(*keys, problem.alias("problem")).where("problem is not null")


def analyze(df: DataFrame) -> DataFrame:
    """(column, rows, distinct): exact numbers of rows and of distinct non-null values of every column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns))).alias("x")).select("x.*")
    per = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return per.groupBy("column").agg(F.sum("n").alias("rows"), F.count("v").alias("distinct"))


def value_histogram(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


class Sequence:
    """nextval, currval and setval in the driver; ids in bulk come from row numbers, in order of the given columns."""

    def __init__(self, start: int = 1, step: int = 1):
        self.value, self.step, self.started, self.start = start, step, False, start

    def nextval(self) -> int:
        self.value = self.value + self.step if self.started else self.start
        self.started = True
        return self.value

    def currval(self) -> int:
        if not self.started:
            raise ValueError("currval before nextval")
        return self.value

    def setval(self, value: int) -> int:
        self.value, self.started = value, True
        return value

    def assign(self, df: DataFrame, name: str, *order: str) -> DataFrame:
        """Consecutive ids in the given order; no task sees more than its range of the rows."""
        first = self.nextval()
        out = stored(numbered(df, [], list(order), "_i"))
        self.value = first + (out.count() - 1) * self.step
        return out.select(*df.columns, (F.lit(first) + F.col("_i") * self.step).alias(name))
