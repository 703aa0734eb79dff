"""Agent memory, traces, metrics, audit chain, provenance and shared state as table operators."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .timeseries import rollup
from .vector import cosine_distance, vector_search


def recall_semantic(memory: DataFrame, agent: str, query, k: int) -> DataFrame:
    """(id, content, distance): the agent's k nearest semantic memories."""
    mine = memory.where((F.col("agent_id") == agent) & (F.col("tier") == "semantic"))
    return vector_search(mine, "embedding", query, "id", k, "cosine").select("id", "content", "distance")


def discover_tools(tools: DataFrame, query, k: int) -> DataFrame:
    return vector_search(tools, "embedding", query, "name", k, "cosine").select("name", "description", "distance")


def recall_short(memory: DataFrame, agent: str, now_ms: int) -> DataFrame:
    return memory.where((F.col("agent_id") == agent) & (F.col("tier") == "short") & (F.col("expires_at").isNull() | (F.col("expires_at") > now_ms)))


def recall_episodic(memory: DataFrame, agent: str, t0: int, t1: int) -> DataFrame:
    return memory.where((F.col("agent_id") == agent) & (F.col("tier") == "episodic") & F.col("ts").between(t0, t1)).orderBy("ts", "seq")


def collect_garbage(memory: DataFrame, now_ms: int) -> DataFrame:
    """Memory without what has expired."""
    return memory.where(F.col("expires_at").isNull() | (F.col("expires_at") > now_ms))


def new_semantic(existing: DataFrame, incoming: DataFrame, distance: float = 0.02) -> DataFrame:
    """Incoming memories that are no near copy of one that the same agent has, nor of an incoming one that is taken before (by id)."""
    old = existing.where("tier = 'semantic'").select("agent_id", F.col("embedding").alias("_e"))
    near = incoming.join(old, "agent_id").where(cosine_distance("embedding", "_e") <= distance).select("id").distinct()
    new = stored(incoming.join(near, "id", "left_anti").select(incoming.columns))
    a, b = (new.select("agent_id", F.col("id").alias(i), F.col("embedding").alias(e)) for i, e in (("id", "_a"), ("before", "_b")))
    open_ = stored(a.join(b, "agent_id").where("before < id").where(cosine_distance("_a", "_b") <= distance).select("id", "before"))
    out = new
    while not open_.isEmpty():
        # What has no open earlier neighbour is taken, and what is near a taken one goes.
        gone = stored(open_.join(open_.select(F.col("id").alias("before")).distinct(), "before", "left_anti").select("id").distinct())
        out = out.join(gone, "id", "left_anti")
        open_ = open_.join(gone, "id", "left_anti")
        open_ = stored(open_.join(gone.select(F.col("id").alias("before")), "before", "left_anti").select("id", "before"))
    return out.select(incoming.columns)


def session_events(trace: DataFrame, session: str) -> DataFrame:
    return trace.where(F.col("session_id") == session).orderBy("evt_offset")


def replay_up_to(trace: DataFrame, session: str, offset: int) -> DataFrame:
    return session_events(trace, session).where(F.col("evt_offset") <= offset)


def first_error(trace: DataFrame) -> DataFrame:
    """The first event with an error of each session."""
    return trace.where(F.col("error").isNotNull()).groupBy("session_id").agg(F.min_by(F.struct("evt_offset", "error"), "evt_offset").alias("e")).select("session_id", "e.*")


def agent_metrics(metrics: DataFrame, agent: str, t0: int, t1: int) -> DataFrame:
    return metrics.where((F.col("agent_id") == agent) & F.col("ts").between(t0, t1))


def success_rate(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("agent_id").agg(F.avg(F.col("success").cast("double")).alias("success_rate"))


def latency_rollup(metrics: DataFrame, interval: str = "1 hour") -> DataFrame:
    return rollup(metrics, interval, "ts", "latency_ms", "agent_id")


def _entry_hash(prev):
    return F.sha2(F.concat_ws("|", prev, F.col("seq").cast("string"), F.col("ts").cast("string"), "actor", "action", "details"), 256)


def audit_chain(log: DataFrame) -> DataFrame:
    """Entries with prev_hash and hash: in each session every hash covers the one before.

    Sessions are sorted, and a task walks its sorted rows batch by batch with the last hash in hand, so no session is gathered.
    """
    names = ["session_id", "seq", "ts", "actor", "action", "details"]
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    rows = log.select(*names).repartition("session_id").sortWithinPartitions("session_id", "seq")

    def walk(batches):
        session, prev = None, ""
        for batch in batches:
            before, hashes = [], []
            for values in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                if values[0] != session:
                    session, prev = values[0], ""
                before.append(prev)
                prev = hashlib.sha256("|".join([prev, *(str(v) for v in values[1:] if v is not None)]).encode()).hexdigest()
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())], [*names, "prev_hash", "hash"])

    return rows.mapInArrow(walk, ", ".join(f"{c} {kinds[c]}" for c in names) + ", prev_hash string, hash string")


def audit_breaks(chain: DataFrame) -> DataFrame:
    """Entries whose hash is wrong or does not follow the one before."""
    w = Window.partitionBy("session_id").orderBy("seq")
    marked = chain.withColumn("_before", F.coalesce(F.lag("hash").over(w), F.lit("")))
    return marked.where((F.col("prev_hash") != F.col("_before")) | (F.col("hash") != _entry_hash(F.col("prev_hash")))).drop("_before")


def provenance_history(facts: DataFrame, fact) -> DataFrame:
    """All records of a fact, oldest first."""
    return facts.where(F.col("fact_ref") == F.lit(fact)).orderBy("seq")


def provenance_latest(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_ref").agg(F.max_by(F.struct("source", "confidence", "seq", "ts"), "seq").alias("p")).select("fact_ref", "p.*")


def shared_state(updates: DataFrame) -> DataFrame:
    """Last writer wins for each (workflow, key)."""
    return updates.groupBy("workflow", "key").agg(F.max_by(F.struct("value", "updated_by", "updated_at"), F.struct("updated_at", "updated_by")).alias("s")).select("workflow", "key", "s.*")
