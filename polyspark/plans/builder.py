"""A small query builder that ends in a DataFrame or in SQL with positional parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    table: str
    columns: tuple[str, ...] = ("*",)
    filters: tuple[tuple[str, object], ...] = field(default=())
    order: tuple[str, bool] | None = None
    most: int | None = None
    skip: int | None = None

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def filter_eq(self, column: str, value) -> Query:
        return replace(self, filters=(*self.filters, (column, value)))

    def order_by(self, column: str, ascending: bool = True) -> Query:
        return replace(self, order=(column, ascending))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def build(self) -> tuple[str, list]:
        sql = f"SELECT {', '.join(self.columns)} FROM {self.table}"
        if self.filters:
            sql += " WHERE " + " AND ".join(f"{c} = ?" for c, _ in self.filters)
        if self.order:
            sql += f" ORDER BY {self.order[0]} {'ASC' if self.order[1] else 'DESC'}"
        if self.most is not None:
            sql += f" LIMIT {int(self.most)}"
        if self.skip is not None:
            sql += f" OFFSET {int(self.skip)}"
        return sql, [v for _, v in self.filters]

    def run(self, spark: SparkSession) -> DataFrame:
        sql, args = self.build()
        return spark.sql(sql, args=args)

    def apply(self, df: DataFrame) -> DataFrame:
        for c, v in self.filters:
            df = df.where(F.col(c) == F.lit(v))
        if self.order:
            df = df.orderBy(F.col(self.order[0]).asc() if self.order[1] else F.col(self.order[0]).desc())
        if self.skip is not None:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*self.columns)
