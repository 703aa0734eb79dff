"""Tables with declared constraints over Parquet folders: checked writes, rewrites, schema changes and a change feed.

A table's state is a sequence of snapshot folders; a write makes the next one, so a failed job leaves the last state whole.
Checks are joins and aggregates over the batch and the table, and every violation is found, not only the first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import document, tables


class ConstraintError(ValueError):
    """What a write breaks, with a few of the rows."""


@dataclass
class ForeignKey:
    column: str
    parent: Table
    key: str


@dataclass
class Index:
    """A declared access path. Spark prunes by itself; operators that take options (metric, interval, edge columns) read them here."""

    name: str
    columns: tuple[str, ...]
    method: str = "btree"
    options: dict = field(default_factory=dict)


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType | str, primary_key: list[str] | None = None, unique: list[list[str]] | None = None, not_null: list[str] | None = None, defaults: dict | None = None, json_schemas: dict[str, tuple[dict, str]] | None = None, cdc=None):
        self.spark, self.name, self.root = spark, name, f"{root.rstrip('/')}/{name}"
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.primary_key, self.unique = primary_key or [], unique or []
        self.not_null = [*(not_null or []), *self.primary_key]
        self.defaults, self.json_schemas, self.cdc = dict(defaults or {}), json_schemas or {}, cdc
        self.foreign_keys: list[ForeignKey] = []
        self.indexes: dict[str, Index] = {}
        self.version = 0

    def references(self, column: str, parent: Table, key: str) -> Table:
        self.foreign_keys.append(ForeignKey(column, parent, key))
        return self

    def create_index(self, name: str, *columns: str, method: str = "btree", **options) -> Index:
        if missing := [c for c in columns if c not in self.schema.names]:
            raise ValueError(f"no such column: {missing}")
        self.indexes[name] = Index(name, columns, method, options)
        return self.indexes[name]

    def read(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{self.version}")

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v{self.version + 1}")
        self.version += 1

    def _conform(self, rows: DataFrame) -> DataFrame:
        """All columns in order and type; missing ones get their defaults."""
        if unknown := set(rows.columns) - set(self.schema.names):
            raise ValueError(f"no such column: {sorted(unknown)}")
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(self.defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def violations(self, rows: DataFrame, kept: DataFrame) -> list[str]:
        """Everything that ``rows`` would break beside the rows in ``kept``."""
        found = []

        def check(what: str, bad: DataFrame) -> None:
            if got := bad.limit(3).collect():
                found.append(f"{self.name}: {what}: {[tuple(r) for r in got]}")

        if self.not_null:
            check("not null", tables.not_null_violations(rows, self.not_null))
        for keys in [*([self.primary_key] if self.primary_key else []), *self.unique]:
            check(f"unique {keys}", tables.unique_violations(rows.select(*keys).unionByName(kept.select(*keys)), keys))
        for fk in self.foreign_keys:
            parents = fk.parent.read() if fk.parent is not self else kept.unionByName(rows)
            check(f"{fk.column} references {fk.parent.name}", tables.fk_violations(rows, fk.column, parents, fk.key))
        for column, (schema, mode) in self.json_schemas.items():
            broken = rows.select(column, document.validate_json(column, schema, mode).alias("why")).where(F.size("why") > 0)
            check(f"JSON schema of {column}", broken)
        return found

    def _commit(self, new: DataFrame, changed: DataFrame, kept: DataFrame, before: DataFrame) -> None:
        if found := self.violations(changed, kept):
            raise ConstraintError("; ".join(found))
        self._write(new)
        if self.cdc is not None and self.primary_key:
            self._publish(before, self.read())

    def _publish(self, before: DataFrame, after: DataFrame) -> None:
        """One JSON record for each changed row on the table's topic."""
        from ..streaming.topics import change_feed

        feed = change_feed(before, after, self.primary_key)
        key = F.concat_ws("|", *(F.col(k).cast("string") for k in self.primary_key))
        body = F.to_json(F.struct("op", F.lit(self.name).alias("table"), key.alias("row_key"), "before", "after"))
        self.cdc.publish(feed.select(key.alias("key"), body.alias("value")))

    def insert(self, rows: DataFrame) -> None:
        rows, old = self._conform(rows), self.read()
        self._commit(old.unionByName(rows), rows, old, old)

    def upsert(self, rows: DataFrame) -> None:
        """Rows with a known primary key replace the old ones."""
        rows, old = self._conform(rows), self.read()
        kept = old.join(rows.select(*self.primary_key), self.primary_key, "left_anti").select(old.columns)
        self._commit(kept.unionByName(rows), rows, kept, old)

    def update(self, condition: str, **values) -> None:
        old = self.read()
        hit = F.coalesce(F.expr(condition), F.lit(False))
        changed = self._conform(tables.update_where(old.where(hit), F.lit(True), **values))
        kept = old.where(~hit)
        self._commit(kept.unionByName(changed), changed, kept, old)

    def delete(self, condition: str) -> None:
        old = self.read()
        kept = tables.delete_where(old, condition)
        self._commit(kept, kept.limit(0), kept, old)

    def add_column(self, name: str, kind: str, default=None) -> None:
        new = tables.add_column(self.read(), name, kind, default)
        self.schema = StructType([*self.schema.fields, new.schema[name]])
        if default is not None:
            self.defaults[name] = default
        self._write(new)

    def drop_column(self, name: str) -> None:
        new = self.read().drop(name)
        self.schema = StructType([f for f in self.schema.fields if f.name != name])
        self.unique = [u for u in self.unique if name not in u]
        self._write(new)

    def set_default(self, name: str, value) -> None:
        self.defaults[name] = value

    def drop_default(self, name: str) -> None:
        self.defaults.pop(name, None)

    def set_not_null(self, name: str) -> None:
        if self.read().where(F.col(name).isNull()).limit(1).count():
            raise ConstraintError(f"{self.name}: {name} has nulls")
        self.not_null.append(name)

    def drop_not_null(self, name: str) -> None:
        self.not_null = [c for c in self.not_null if c != name]

    def describe(self) -> str:
        """Columns, constraints and indexes as JSON."""
        return json.dumps({"table": self.name, "columns": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.name not in self.not_null, "default": self.defaults.get(f.name)} for f in self.schema.fields], "primary_key": self.primary_key, "unique": self.unique, "foreign_keys": [[f.column, f.parent.name, f.key] for f in self.foreign_keys], "indexes": {k: {"columns": list(v.columns), "method": v.method, **v.options} for k, v in self.indexes.items()}})
