"""Time buckets, rollups, retention and gap handling over unix-millisecond columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_MS = {"ms": 1, "s": 1_000, "sec": 1_000, "second": 1_000, "min": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000, "w": 604_800_000, "week": 604_800_000, "month": 2_592_000_000}


def interval_ms(text: str) -> int:
    """'1 hour', '30 days', '5 s' or '250 ms' in milliseconds; a month has 30 days. Anything else raises ValueError."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", text.lower())
    unit = m and (m[2] if m[2] in UNIT_MS else m[2].removesuffix("s"))
    if not m or unit not in UNIT_MS or not int(m[1]):
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * UNIT_MS[unit]


def millis(ts: Column | str) -> Column:
    """Unix milliseconds of a timestamp column, with or without time zone (the session is UTC)."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_bucket(interval: str, ts_ms: Column | str) -> Column:
    """Start of the bucket that holds a unix-millisecond time; right for times before 1970 too."""
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return ts - F.pmod(ts, F.lit(interval_ms(interval)))


def in_bucket(interval: str, ts_ms: str, start: int) -> Column:
    """``time_bucket(interval, ts) = start`` as a range, which prunes files and row groups."""
    size = interval_ms(interval)
    return F.lit(start % size == 0) & (F.col(ts_ms) >= start) & (F.col(ts_ms) < start + size)


def rollup(df: DataFrame, interval: str, ts_ms: str, value: str, *keys: str) -> DataFrame:
    """count, sum, min and max of each bucket (and key)."""
    return df.groupBy(*keys, time_bucket(interval, ts_ms).alias("bucket")).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def rollup_query(df: DataFrame, interval: str, ts_ms: str, value: str, t0: int, t1: int) -> DataFrame:
    """The rollup of the buckets that start in t0..t1; the time range reaches the scan."""
    size = interval_ms(interval)
    low = t0 + (-t0) % size
    return rollup(df.where((F.col(ts_ms) >= low) & (F.col(ts_ms) < t1 - t1 % size + size)), interval, ts_ms, value)


def retained(df: DataFrame, ts_ms: str, retention: str, interval: str = "1 hour") -> DataFrame:
    """Raw rows of the buckets that end after the newest time less the retention; rollups are kept elsewhere for all."""
    newest = df.agg(F.max(ts_ms).alias("_newest"))
    end = time_bucket(interval, ts_ms) + interval_ms(interval)
    return df.join(F.broadcast(newest), end > F.col("_newest") - interval_ms(retention)).drop("_newest")


def moving_average(value: str, n: int, order: list, partition: list | None = None) -> Column:
    """Mean of the last n rows, nulls skipped."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    return F.avg(value).over(Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(1 - n, 0))


def interpolate(df: DataFrame, value: str, order: list[str], partition: list[str], out: str = "interpolated") -> DataFrame:
    """Nulls filled by row position between the nearest known neighbours; at an edge the only neighbour; without any, null."""
    w = Window.partitionBy(*partition).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_rn", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_rn").alias("rn"), F.col(value).cast("double").alias("v")))
    df = df.withColumn("_lo", F.last(known, True).over(back)).withColumn("_hi", F.first(known, True).over(ahead))
    line = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col("_rn") - F.col("_lo.rn")) / (F.col("_hi.rn") - F.col("_lo.rn"))
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), line)
    return df.withColumn(out, filled.otherwise(F.coalesce("_lo.v", "_hi.v"))).drop("_rn", "_lo", "_hi")


def gap_fill(df: DataFrame, interval: str, bucket: str, *values: str) -> DataFrame:
    """A row for every bucket between the first and the last; values of added rows are null."""
    size = interval_ms(interval)
    span = df.agg(F.min(bucket).alias("a"), F.max(bucket).alias("b")).where("a is not null")
    grid = span.select(F.explode(F.sequence("a", "b", F.lit(size))).alias(bucket))
    return grid.join(df, bucket, "left").select(bucket, *values)


def lag_by(df: DataFrame, value: str, k: str, order: list[str], partition: list[str], out: str = "lagged") -> DataFrame:
    """lag with a distance of its own in each row: an equi-join on the row number."""
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = df.withColumn("_rn", F.row_number().over(w))
    far = rows.select(*partition, F.col("_rn").alias("_at"), F.col(value).alias(out))
    return rows.withColumn("_at", F.col("_rn") - F.col(k)).join(far, [*partition, "_at"], "left").drop("_rn", "_at")


def ntile_by_formula(n: int, order: list, partition: list) -> Column:
    """Tiles of floor(position * n / rows) + 1; differs from the standard ntile where n does not divide the rows."""
    w = Window.partitionBy(*partition)
    return F.least(F.lit(n), F.floor((F.row_number().over(w.orderBy(*order)) - 1) * n / F.count(F.lit(1)).over(w)) + 1)
