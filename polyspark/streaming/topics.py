"""Topics as append-only tables (topic, partition, offset, key, value, timestamp_ms), change feeds and time travel."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import numbered

OFFSET = "reader string, partition int, next_offset long, at long"
RECORD = "topic string, partition int, offset long, key string, value string, timestamp_ms long"


class Topic:
    """One topic under a folder; publishing appends, readers poll from committed offsets (at least once)."""

    def __init__(self, spark: SparkSession, root: str, name: str, partitions: int = 1, retention_ms: int | None = None, retention_bytes: int | None = None):
        self.spark, self.name, self.partitions = spark, name, partitions
        self.path = f"{root.rstrip('/')}/{name}"
        self.retention_ms, self.retention_bytes = retention_ms, retention_bytes

    def _table(self, path: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def read(self) -> DataFrame:
        return self._table(self.path, RECORD)

    def publish(self, records: DataFrame) -> None:
        """``records``: key, value and optionally timestamp_ms. Keys decide the partition; records without one are spread."""
        now = F.lit(int(time.time() * 1000))
        ts = F.coalesce("timestamp_ms", now) if "timestamp_ms" in records.columns else now
        spread = F.pmod(F.when(F.col("key").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("key")), F.lit(self.partitions)).cast("int")
        base = self.read().groupBy("partition").agg((F.max("offset") + 1).alias("base"))
        rows = records.select(F.lit(self.name).alias("topic"), spread.alias("partition"), F.col("key").cast("string"), F.col("value").cast("string"), ts.alias("timestamp_ms"))
        # One row of base for each topic partition, whose number is given: small whatever the records.
        rows = numbered(rows, ["partition"], ["timestamp_ms", "key", "value"], "place").join(F.broadcast(base), "partition", "left")
        rows.withColumn("offset", (F.col("place") + F.coalesce("base", F.lit(0))).cast("long")).select("topic", "partition", "offset", "key", "value", "timestamp_ms").write.mode("append").parquet(self.path)

    def poll(self, group: str, partition: int, limit: int) -> DataFrame:
        """The next records after the group's committed offset; the same ones again until they are committed."""
        start = self.committed(group, partition)
        return self.read().where((F.col("partition") == partition) & (F.col("offset") >= start)).orderBy("offset").limit(limit)

    def commit(self, group: str, partition: int, next_offset: int) -> None:
        """Offsets lie beside the topic and outlive this object and its driver; the last commit counts."""
        row = self.spark.createDataFrame([(group, partition, next_offset, time.time_ns())], OFFSET)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}.offsets")

    def committed(self, group: str, partition: int) -> int:
        of = self._table(f"{self.path}.offsets", OFFSET).where((F.col("reader") == group) & (F.col("partition") == partition))
        return of.agg(F.max_by("next_offset", "at").alias("n")).first().n or 0

    def retained(self) -> DataFrame:
        out = self.read()
        if self.retention_ms is not None:
            out = retained_by_time(out, self.retention_ms)
        if self.retention_bytes is not None:
            out = retained_by_bytes(out, self.retention_bytes)
        return out


def retained_by_time(log: DataFrame, retention_ms: int) -> DataFrame:
    """Records not older than the newest one of their partition less the retention."""
    newest = log.groupBy("partition").agg(F.max("timestamp_ms").alias("_newest"))  # a row for each topic partition
    return log.join(F.broadcast(newest), "partition").where(F.col("timestamp_ms") >= F.col("_newest") - retention_ms).drop("_newest")


def retained_by_bytes(log: DataFrame, limit: int) -> DataFrame:
    """The newest records of each partition whose values fit the limit together."""
    w = Window.partitionBy("partition").orderBy(F.col("offset").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("_sum", F.sum(F.octet_length("value")).over(w)).where(F.col("_sum") <= limit).drop("_sum")


def time_travel(log: DataFrame, cutoff_ms: int) -> DataFrame:
    """(row_key, data): each key's last state up to the cutoff; ``log`` has row_key, op, after, ts and offset. Deleted keys are absent.

    The last change is a grouped maximum, so a key with very many changes is combined on the map side.
    """
    last = log.where(F.col("ts") <= cutoff_ms).groupBy("row_key").agg(F.max_by(F.struct("op", "after"), "offset").alias("last"))
    return last.where("last.op <> 'delete'").select("row_key", F.col("last.after").alias("data"))


def change_feed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op, before, after): inserts, updates and deletes between two states of a table."""
    values = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*values).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.struct(*values).alias("after"), F.lit(True).alias("_b"))
    op = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return a.join(b, keys, "full_outer").withColumn("op", op).where("op is not null").select(*keys, "op", "before", "after")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A topic's folder as a live stream with an event-time column ``timestamp``."""
    return spark.readStream.schema(RECORD).parquet(path).withColumn("timestamp", F.timestamp_millis("timestamp_ms"))


def subscribe(stream: DataFrame, handler, checkpoint: str, available_now: bool = False):
    """Push each new batch of records to ``handler(df, batch_id)``; offsets live in the checkpoint folder (at least once)."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_kafka(spark: SparkSession, servers: str, topic: str, live: bool = True, **options) -> DataFrame:
    """A Kafka topic in the record shape used here (the connector's jar must be on the class path)."""
    reader = (spark.readStream if live else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    key, value = F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    return reader.load().select("topic", "partition", "offset", key, value, F.unix_millis("timestamp").alias("timestamp_ms"))
