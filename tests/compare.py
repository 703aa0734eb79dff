"""Rows of a Spark query against rows of SQL on the same Parquet tables."""

import math

import duckdb
import pandas as pd

from polyspark.session import TABLES


def rows_of(frame):
    def show(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "NULL"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}" if math.isfinite(v) else str(v)
        return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(show(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def spark_rows(df):
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
