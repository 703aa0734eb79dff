"""Tumbling, sliding and session windows over topic records, for finished logs and for live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that a log without keys is cut into for sessions.
CHUNKS = 1024


def tumbling(df: DataFrame, width_ms: int, ts: str = "timestamp_ms") -> DataFrame:
    """(window_start, window_end, count) of non-empty windows."""
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(width_ms))
    return df.groupBy(start.alias("window_start")).agg(F.count("*").alias("count")).select("window_start", (F.col("window_start") + width_ms).alias("window_end"), "count")


def sliding(df: DataFrame, size_ms: int, slide_ms: int, ts: str = "timestamp_ms") -> DataFrame:
    """Windows [e - size, e) for every multiple e of the slide; any slide, also one longer than the size."""
    first = F.floor(F.col(ts) / slide_ms) * slide_ms + slide_ms
    ends = F.when(first <= F.col(ts) + size_ms, F.sequence(first, F.col(ts) + size_ms, F.lit(slide_ms)))
    each = df.select(F.explode(ends).alias("window_end"))
    return each.groupBy("window_end").agg(F.count("*").alias("count")).select((F.col("window_end") - size_ms).alias("window_start"), "window_end", "count")


def session(df: DataFrame, gap_ms: int, ts: str = "timestamp_ms", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sessions whose neighbours are at most the gap apart; they end at their last event.

    With keys, every key has sessions of its own and the work is spread by key. Without keys the log is one sequence: it is cut
    into CHUNKS stretches of time, sessions are found within each, and only one row for each stretch decides which of them
    run on into the next.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(ts)
        new = F.when(F.col(ts) - F.lag(ts).over(w) <= gap_ms, 0).otherwise(1)
        marked = df.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*keys, "_s").agg(F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), F.count("*").alias("count")).drop("_s")
    times = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("at")).agg(F.count("*").alias("n"))
    span = times.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    chunk = F.floor((F.col("at") - F.col("a")) / F.greatest((F.col("b") - F.col("a")) / CHUNKS, F.lit(1)))
    times = times.crossJoin(F.broadcast(span)).select("at", "n", chunk.alias("k"))
    w = Window.partitionBy("k").orderBy("at")
    times = times.withColumn("new", F.when(F.col("at") - F.lag("at").over(w) <= gap_ms, 0).otherwise(1))
    parts = times.withColumn("i", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "i").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("n").alias("n"))
    # One row a stretch: whether it joins on to the one before, and where the session that leaves it began.
    edge = parts.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("i").alias("m"))
    by_k = Window.orderBy("k")
    edge = edge.withColumn("linked", F.coalesce(F.col("lo") - F.lag("hi").over(by_k) <= gap_ms, F.lit(False)))
    own = F.when((F.col("m") > 1) | ~F.col("linked"), F.struct("k", F.col("m").alias("i")))
    edge = edge.withColumn("leaves", F.last(own, True).over(by_k.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("enters", F.when(F.col("linked"), F.lag("leaves").over(by_k))).select("k", "enters")
    whole = parts.join(F.broadcast(edge), "k").withColumn("s", F.when(F.col("i") == 1, F.coalesce("enters", F.struct("k", "i"))).otherwise(F.struct("k", "i")))
    return whole.groupBy("s").agg(F.min("lo").alias("window_start"), F.max("hi").alias("window_end"), F.sum("n").alias("count")).drop("s")


def stream_tumbling(stream: DataFrame, width: str, watermark: str, ts: str = "timestamp") -> DataFrame:
    """Live twin: counts by window; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, width)).agg(F.count("*").alias("count")).select("window.start", "window.end", "count")


def stream_sliding(stream: DataFrame, size: str, slide: str, watermark: str, ts: str = "timestamp") -> DataFrame:
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, size, slide)).agg(F.count("*").alias("count")).select("window.start", "window.end", "count")


def stream_session(stream: DataFrame, gap: str, watermark: str, ts: str = "timestamp", keys: tuple[str, ...] = ()) -> DataFrame:
    """Live twin: a session ends at its last event."""
    grouped = stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), *keys)
    return grouped.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("count")).select(*keys, "start", "end", "count")
