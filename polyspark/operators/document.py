"""JSON operators and the document aggregation pipeline over JSON text columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _path(keys) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arrow(doc, key) -> Column:
    """``doc -> key`` as JSON text (strings keep their quotes); missing or JSON null gives null."""
    return extract(doc, key)


def extract(doc, *keys) -> Column:
    """``doc #> path``: JSON text at a path of field names and array places."""
    if any(isinstance(k, int) and k < 0 for k in keys):
        return F.lit(None).cast("string")
    got = F.to_json(F.try_variant_get(F.try_parse_json(_col(doc)), _path(keys), "variant"))
    return F.nullif(got, F.lit("null"))


def extract_text(doc, *keys) -> Column:
    """``doc ->> key`` and ``doc #>> path``: as text, strings without quotes."""
    if any(isinstance(k, int) and k < 0 for k in keys):
        return F.lit(None).cast("string")
    return F.get_json_object(_col(doc), _path(keys))


def json_typeof(doc) -> Column:
    s = F.schema_of_variant(F.try_parse_json(_col(doc)))
    kind = F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    return F.when(s.isNotNull(), kind.otherwise("number"))


def json_valid(doc) -> Column:
    doc = _col(doc)
    return doc.isNull() | F.try_parse_json(doc).isNotNull()


def json_array_length(doc) -> Column:
    return F.json_array_length(_col(doc))


def build_object(**fields: Column) -> Column:
    """An object with sorted keys; null fields stay as JSON null."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def build_array(*values: Column) -> Column:
    return F.to_json(F.array(*values))


def _contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_contains(x, y) for x in a) for y in b)
    return type(a) is type(b) and a == b


def json_contains_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _contains(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype="object")


def json_contains(a, b) -> Column:
    """``a @> b``: every part of b is in a; 1 and 1.0 differ."""
    return F.pandas_udf(json_contains_series, "boolean")(_col(a), _col(b))


def _set(doc, path, value, create):
    if not path:
        return value
    key, rest = path[0], path[1:]
    if isinstance(doc, dict):
        if key in doc or create:
            inner = doc.get(key, {} if rest else None)
            doc = dict(doc) | {key: _set(inner, rest, value, create) if rest else value}
    elif isinstance(doc, list) and key.lstrip("-").isdigit():
        i, doc = int(key), list(doc)
        if 0 <= i < len(doc):
            doc[i] = _set(doc[i], rest, value, create)
        elif create and not rest and i >= len(doc):
            doc.append(value)
    return doc


def json_set(doc, path: list[str], value, create: bool = True) -> Column:
    """The document with the value at the path; missing object parents are made, an array place past the end appends."""

    def run(d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else json.dumps(_set(json.loads(x), path, json.loads(y) if y is not None else None, create), separators=(",", ":"), sort_keys=True) for x, y in zip(d, v)], dtype="object")

    return F.pandas_udf(run, "string")(_col(doc), _col(value) if isinstance(value, Column) else F.lit(json.dumps(value)))


def json_path_lookup(df: DataFrame, key: str, doc: str, path: str, value: str) -> DataFrame:
    """Keys of the rows whose leaf at a dotted path equals the value as text."""
    return df.where(extract_text(doc, *(int(p) if p.isdigit() else p for p in path.split("."))) == F.lit(value)).select(key)


def flatten_json(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, depth, path, value, is_leaf) of every node, depth first."""

    def run(batches):
        for b in batches:
            rows = []
            for k, d in zip(b[key], b[doc]):
                if d is None:
                    continue
                todo = [(0, "$", json.loads(d))]
                while todo:
                    depth, path, v = todo.pop()
                    leaf = not isinstance(v, (dict, list))
                    rows.append((k, depth, path, json.dumps(v) if leaf else None, leaf))
                    kids = [(f"{path}.{x}", y) for x, y in v.items()] if isinstance(v, dict) else [(f"{path}[{i}]", y) for i, y in enumerate(v)] if isinstance(v, list) else []
                    todo += [(depth + 1, p, y) for p, y in reversed(kids)]
            yield pd.DataFrame(rows, columns=[key, "depth", "path", "value", "is_leaf"])

    return df.select(key, doc).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, depth int, path string, value string, is_leaf boolean")


# ---------------------------------------------------------------- aggregation pipeline

COMPARE = {"$eq": lambda c, v: c.eqNullSafe(v), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def _value(v) -> Column:
    """``"$field"`` is a column, anything else a literal."""
    return F.col(v[1:]) if isinstance(v, str) and v.startswith("$") else F.lit(v)


def _match(spec: dict) -> Column:
    out = F.lit(True)
    for field, cond in spec.items():
        c = F.col(field)
        for op, v in (cond if isinstance(cond, dict) else {"$eq": cond}).items():
            if op == "$ne":
                test = ~c.eqNullSafe(F.lit(v))
            elif op in ("$in", "$nin"):
                test = F.coalesce(c.isin([x for x in v if x is not None]), F.lit(False)) | (c.isNull() if None in v else F.lit(False))
                test = ~test if op == "$nin" else test
            elif op in COMPARE:
                test = COMPARE[op](c, F.lit(v))
            else:
                test = F.lit(False)
            out = out & F.coalesce(test, F.lit(False))
    return out


def _accumulator(spec: dict, ordered: bool) -> Column:
    """``_pos`` is a row's place in its group where rows are ordered."""
    (op, arg), = spec.items()
    if op == "$count":
        return F.count(F.lit(1)).cast("double")
    if op == "$sum":
        return F.count(F.lit(1)) * F.lit(float(arg)) if not isinstance(arg, str) else F.coalesce(F.sum(_value(arg).cast("double")), F.lit(0.0))
    if op == "$avg":
        return F.avg(_value(arg).cast("double"))
    if op == "$min":
        return F.min(_value(arg))
    if op == "$max":
        return F.max(_value(arg))
    if op == "$first":
        return F.min_by(_value(arg), "_pos") if ordered else F.first(_value(arg))
    if op == "$push":
        items = F.collect_list(F.struct(*(["_pos"] if ordered else []), _value(arg).alias("v")))
        return F.transform(F.array_sort(items) if ordered else items, lambda x: x["v"])
    raise ValueError(f"unknown accumulator: {op}")


def run_pipeline(df: DataFrame, stages: list[dict] | str, order_by: list[str] | None = None) -> DataFrame:
    """$match, $group, $project, $sort, $limit and $skip as DataFrame operations. ``order_by`` is the row order for $first and $push when no $sort precedes."""
    stages = json.loads(stages) if isinstance(stages, str) else stages
    sorts = [F.col(c) for c in order_by or []]
    for stage in stages:
        if len(stage) != 1:
            raise ValueError("a stage has one key")
        (op, spec), = stage.items()
        if op == "$match":
            df = df.where(_match(spec))
        elif op == "$group":
            key = spec["_id"]
            if isinstance(key, dict):
                key = F.to_json(F.struct(*(_value(v).alias(k) for k, v in key.items())), {"ignoreNullFields": "false"})
            else:
                key = _value(key)
            made = {k: v for k, v in spec.items() if k != "_id"}
            ordered = bool(sorts) and any(op in ("$first", "$push") for v in made.values() for op in v)
            df = df.withColumn("_key", key)
            if ordered:
                df = df.withColumn("_pos", F.row_number().over(Window.partitionBy("_key").orderBy(*sorts)))
            df = df.groupBy(F.col("_key").alias("_id")).agg(*(_accumulator(v, ordered).alias(k) for k, v in made.items()))
            sorts = []
        elif op == "$project":
            drop = [k for k, v in spec.items() if v in (0, False) and not isinstance(v, str)]
            keep = ["_id"] if "_id" in df.columns and "_id" not in spec else []
            if drop and len(drop) == len(spec):
                df = df.drop(*drop)
            else:
                df = df.select(*keep, *((F.col(k) if v is True or v == 1 else _value(v)).alias(k) for k, v in spec.items() if k not in drop))
        elif op == "$sort":
            sorts = [F.col(k).asc() if v > 0 else F.col(k).desc() for k, v in spec.items()]
            df = df.orderBy(*sorts)
        elif op == "$limit":
            df = df.limit(spec)
        elif op == "$skip":
            df = df.offset(spec)
        else:
            raise ValueError(f"unknown stage: {op}")
    return df


# ---------------------------------------------------------------- JSON Schema

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is_kind(v, kind: str) -> bool:
    if kind == "number":
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind == "integer":
        return isinstance(v, int) and not isinstance(v, bool)  # 1.0 is a number but no integer
    return kind not in KINDS or isinstance(v, KINDS[kind])  # an unknown name accepts everything


def schema_violations(v, schema: dict, at: str = "$") -> list[str]:
    """What breaks a schema of type, enum, required, properties, items, minimum, maximum, minLength and maxLength."""
    out = []
    kinds = schema.get("type")
    if kinds and not any(_is_kind(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    if "enum" in schema and v not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(v, dict):
        out += [f"{at}: {k} is required" for k in schema.get("required", []) if k not in v]
        for k, s in schema.get("properties", {}).items():
            if k in v:
                out += schema_violations(v[k], s, f"{at}.{k}")
    if isinstance(v, list) and "items" in schema:
        for i, x in enumerate(v):
            out += schema_violations(x, schema["items"], f"{at}[{i}]")
    if _is_kind(v, "number"):
        out += [f"{at}: below minimum"] * ("minimum" in schema and v < schema["minimum"]) + [f"{at}: above maximum"] * ("maximum" in schema and v > schema["maximum"])
    if isinstance(v, str):
        out += [f"{at}: too short"] * (len(v) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(v) > schema.get("maxLength", len(v)))
    return out


def validate_json(doc, schema: dict, mode: str = "strict") -> Column:
    """Violations of each document as array<string>: strict checks everything, relaxed the top type only, off nothing."""
    if mode == "off":
        return F.expr("cast(array() as array<string>)")
    used = schema if mode == "strict" else {k: v for k, v in schema.items() if k == "type"}

    def run(docs: pd.Series) -> pd.Series:
        def one(d):
            if d is None:
                return []
            try:
                return schema_violations(json.loads(d), used)
            except ValueError:
                return ["$: not JSON"]

        return docs.map(one) if len(docs) else docs

    return F.pandas_udf(run, "array<string>")(_col(doc))
