"""Queries of the domain operators over the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent, document, geo, graph, raster, tables, text, timeseries, vector
from ..session import load, prepare
from ..streaming import topics, windows

DAY, HOUR = 86_400_000, 3_600_000


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """events as (event_id, user_id, ts ms, value), a seventh of the values null."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return load(prepare(spark), d, "events").select("event_id", "user_id", "event_type", timeseries.millis("ts").alias("ts"), value.alias("value"))


METRICS = "m AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to supplier, as text so that the two kinds of keys stay apart."""
    e = load(prepare(spark), d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return e.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("o_orderpriority").alias("rel")).distinct()


EDGES = "e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, o_orderpriority AS rel FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _ring(spark: SparkSession, d: str) -> DataFrame:
    """A graph on nations: chords of 3 and 7 within the ring of keys, region by region for the first ten."""
    n = load(prepare(spark), d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return n.select(F.col("k").alias("src"), F.explode(F.array(F.col("k") * 3 % 25, F.col("k") * 7 % 25, (F.col("k") + 5) % 25)).alias("dst"))


RING = "e AS (SELECT k AS src, unnest([k * 3 % 25, k * 7 % 25, (k + 5) % 25]) AS dst FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation))"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Every customer linked to the one with half its key, below 32 to the rest by 4: four trees that deepen with the table."""
    c = load(prepare(spark), d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return c.select(F.col("k").alias("src"), F.expr("CASE WHEN k < 32 THEN k % 4 ELSE k div 2 END").alias("dst"))


TREE = "e AS (SELECT CAST(c_custkey AS BIGINT) AS src, CAST(CASE WHEN c_custkey < 32 THEN c_custkey % 4 ELSE c_custkey // 2 END AS BIGINT) AS dst FROM customer)"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Customer to part, part to supplier and supplier to customer of every line item."""
    e = load(prepare(spark), d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    c, p, s = (F.concat(F.lit(x), k) for x, k in (("c", "o_custkey"), ("p", "l_partkey"), ("s", "l_suppkey")))
    return e.select(F.explode(F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in ((c, p), (p, s), (s, c))))).alias("e")).select("e.*")


TRIPLES = "k AS (SELECT 'c' || o_custkey AS c, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT c AS src, p AS dst FROM k UNION ALL SELECT p, s FROM k UNION ALL SELECT s, c FROM k)"


def _places(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    k = F.col(key).cast("double")
    return load(prepare(spark), d, table).select(F.col(key).alias(key), ((k * 37) % 360 - 180).alias(f"{key}_x"), ((k * 53) % 170 - 85).alias(f"{key}_y"))


def _places_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, (CAST({key} AS DOUBLE) * 37) % 360 - 180 AS {key}_x, (CAST({key} AS DOUBLE) * 53) % 170 - 85 AS {key}_y FROM {table})"


def _haversine(x1: str, y1: str, x2: str, y2: str) -> str:
    x1, y1, x2, y2 = (f"({v})" for v in (x1, y1, x2, y2))
    return f"(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)))))"


CP, SP = _places_sql("customer", "c_custkey"), _places_sql("supplier", "s_suppkey")
TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

# ---------------------------------------------------------------- time


def time_bucket(spark, d):
    m = _metrics(spark, d)
    return m.groupBy(timeseries.time_bucket("1 day", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).where("n > 2")


def time_bucket_range(spark, d):
    m = _metrics(spark, d)
    return m.where(timeseries.in_bucket("1 day", "ts", 1_704_153_600_000)).select("event_id", "ts")


def rollup(spark, d):
    return timeseries.rollup(_metrics(spark, d), "6 hours", "ts", "value", "event_type").select("event_type", "bucket", "count", F.round("sum", 4).alias("sum"), "min", "max")


def rollup_retention(spark, d):
    return timeseries.retained(_metrics(spark, d), "ts", "2 days", "1 hour").select("event_id", "ts")


def moving_average(spark, d):
    return _metrics(spark, d).select("event_id", F.round(timeseries.moving_average("value", 4, ["ts", "event_id"], ["user_id"]), 6).alias("ma"))


def interpolate(spark, d):
    return timeseries.interpolate(_metrics(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", F.round("interpolated", 6).alias("filled"))


def gap_fill(spark, d):
    m = _metrics(spark, d)
    return timeseries.gap_fill(m.groupBy(timeseries.time_bucket("6 hours", "ts").alias("bucket")).agg(F.count("*").alias("n")), "6 hours", "bucket", "n")


def gap_fill_all(spark, d):
    """All events by minute, which leaves real gaps; n is 0 in an added bucket."""
    b = _metrics(spark, d).groupBy(timeseries.time_bucket("1 minute", "ts").alias("bucket")).agg(F.count("*").alias("n"))
    return timeseries.gap_fill(b, "1 minute", "bucket", "n").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("gap"))


def lag_by_row(spark, d):
    m = _metrics(spark, d).withColumn("k", F.col("event_id") % 3)
    return timeseries.lag_by(m, "event_id", "k", ["ts", "event_id"], ["user_id"]).select("event_id", "lagged")


def ntile_formula(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", timeseries.ntile_by_formula(4, ["c_acctbal", "c_custkey"], ["c_mktsegment"]).cast("long").alias("tile"))


# ---------------------------------------------------------------- documents and text


def json_arrow(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", document.arrow("props", "k").alias("j"), document.extract_text("props", "k").alias("t"), document.extract_text("props", "missing").alias("none"))


def json_typeof_valid(spark, d):
    e = load(spark, d, "events").withColumn("j", F.when(F.col("event_id") % 5 == 0, "[1,2]").when(F.col("event_id") % 5 == 1, '"x"').when(F.col("event_id") % 5 == 2, "{broken").otherwise(F.col("props")))
    return e.select("event_id", document.json_typeof("j").alias("kind"), document.json_valid("j").alias("ok"), document.json_array_length(F.when(document.json_valid("j"), F.col("j"))).cast("long").alias("n"))


def json_contains(spark, d):
    o = load(spark, d, "orders")
    j = document.build_object(status=F.col("o_orderstatus"), key=F.col("o_orderkey"))
    return o.select("o_orderkey", document.json_contains(j, F.lit('{"status":"F"}')).alias("hit"))


def json_build_set(spark, d):
    j = document.build_object(status=F.col("o_orderstatus"), key=F.col("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", document.json_set(j, ["extra", "n"], 5).alias("j"))


def json_path_lookup(spark, d):
    return document.json_path_lookup(load(spark, d, "events"), "event_id", "props", "k", "87")


def pipeline_group(spark, d):
    stages = [{"$match": {"o_totalprice": {"$gt": 50000}, "o_orderstatus": {"$ne": "P"}}}, {"$group": {"_id": "$o_orderpriority", "total": {"$sum": "$o_totalprice"}, "n": {"$count": {}}, "mean": {"$avg": "$o_totalprice"}, "low": {"$min": "$o_orderkey"}, "high": {"$max": "$o_orderkey"}}}, {"$sort": {"_id": 1}}]
    out = document.run_pipeline(load(spark, d, "orders"), stages)
    return out.select("_id", F.round("total", 2).alias("total"), "n", F.round("mean", 4).alias("mean"), "low", "high")


def pipeline_project(spark, d):
    stages = [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 3}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "price": "$o_totalprice", "tag": "top"}}]
    return document.run_pipeline(load(spark, d, "orders"), stages)


def fts_and(spark, d):
    return text.text_search(load(spark, d, "documents"), "doc_id", "text", "the and of")


def bm25(spark, d):
    return text.bm25(load(spark, d, "documents"), "doc_id", "text", "license the license password").select("doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- vectors


def _query_vector(spark, d):
    return load(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _vectors(spark, d):
    return load(prepare(spark), d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d)))


def l2_topk(spark, d):
    return vector.vector_search(_vectors(spark, d), "embedding", F.col("q"), "vec_id", 10, "l2").select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


def cosine_topk(spark, d):
    return vector.vector_search(_vectors(spark, d), "embedding", F.col("q"), "vec_id", 10, "cosine").select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


def dot_product(spark, d):
    return _vectors(spark, d).select("vec_id", (F.round(vector.dot_product("embedding", "q"), 6) + 0.0).alias("dot"), vector.vector_dims("embedding").cast("long").alias("dims"))


def hybrid_rrf(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text").join(_vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding", "q"), "doc_id")
    flat = docs.select("doc_id", "text", vector.l2_distance("embedding", "q").alias("far"))
    flat = flat.withColumn("v", F.array("far"))
    out = vector.hybrid_search(flat, "doc_id", "v", [0.0], "text", "license password", 10)
    return out.select("doc_id", F.round("vec_distance", 6).alias("vec_distance"), F.round("bm25_score", 6).alias("bm25_score"), F.round("fused_score", 8).alias("fused_score"))


# ---------------------------------------------------------------- streams


def _log(spark, d):
    return _metrics(spark, d).select(F.col("ts").alias("timestamp_ms"), F.col("user_id").alias("key"), "event_id")


def tumbling(spark, d):
    return windows.tumbling(_log(spark, d), 6 * HOUR)


def sliding(spark, d):
    return windows.sliding(_log(spark, d), 10 * HOUR, 4 * HOUR)


def sliding_sparse(spark, d):
    return windows.sliding(_log(spark, d), HOUR, 5 * HOUR)


def session(spark, d):
    return windows.session(_log(spark, d), 10 * 60_000)


def session_by_key(spark, d):
    return windows.session(_log(spark, d), 6 * HOUR, keys=("key",))


def time_travel(spark, d):
    e = _metrics(spark, d)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    log = e.select(F.col("user_id").alias("row_key"), op.alias("op"), F.to_json(F.struct("event_id")).alias("after"), "ts", F.col("event_id").alias("offset"))
    return topics.time_travel(log, 1_704_844_800_000)


def cdc_diff(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("p"))
    before = o.where("o_orderkey % 5 <> 0")
    after = o.where("o_orderkey % 7 <> 0").withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("p")))
    return topics.change_feed(before, after, ["o_orderkey"]).select("o_orderkey", "op", F.col("before.p").alias("old"), F.col("after.p").alias("new"))


def topic_retention(spark, d):
    log = _metrics(spark, d).select((F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.repeat(F.lit("x"), (F.col("event_id") % 9 + 1).cast("int")).alias("value"), F.col("ts").alias("timestamp_ms"))
    return topics.retained_by_bytes(topics.retained_by_time(log, 20 * DAY), 500).select("partition", "offset")


# ---------------------------------------------------------------- graphs


def graph_neighbors(spark, d):
    return graph.neighbors(_edges(spark, d), "c1", "out")


def graph_bfs(spark, d):
    return graph.bfs(_ring(spark, d), 1, 4, "out").select("vertex", F.col("depth").cast("long").alias("depth"))


def graph_shortest_path(spark, d):
    return graph.shortest_path(_tree(spark, d), 100, 141).select(F.col("step").cast("long").alias("step"), "vertex")


def graph_components(spark, d):
    return graph.connected_components(_tree(spark, d))


def graph_pagerank(spark, d):
    return graph.pagerank(_ring(spark, d), 3).select("vertex", F.round("score", 9).alias("score"))


def graph_triangles(spark, d):
    return graph.triangle_count(_ring(spark, d))


def graph_labels(spark, d):
    return graph.label_propagation(_ring(spark, d), 1)


def graph_bfs_all(spark, d):
    return graph.bfs(_edges(spark, d), "c1", direction="both").select("vertex", F.col("depth").cast("long").alias("depth"))


def graph_shortest_path_all(spark, d):
    return graph.shortest_path(_edges(spark, d), "c1", "c2").select(F.col("step").cast("long").alias("step"), "vertex")


def graph_components_all(spark, d):
    return graph.connected_components(_edges(spark, d))


def graph_pagerank_all(spark, d):
    return graph.pagerank(_edges(spark, d)).select("vertex", F.round("score", 9).alias("score"))


def graph_triangles_all(spark, d):
    return graph.triangle_count(_triples(spark, d))


def graph_labels_all(spark, d):
    return graph.label_propagation(_edges(spark, d))


def graph_match_2hop(spark, d):
    e = _edges(spark, d).withColumn("rel", F.concat(F.lit("R"), F.substring("rel", 1, 1)))
    return graph.match_path(e, "(a)-[:R1]->(b)<-[:R5]-(c)", ["a", "c"], {"a": "c1"})


# ---------------------------------------------------------------- geometry


def st_distance(spark, d):
    c = _places(spark, d, "customer", "c_custkey")
    return c.select("c_custkey", F.round(geo.st_distance(geo.st_point("c_custkey_x", "c_custkey_y"), geo.st_point(F.lit(2.3522), F.lit(48.8566))), 3).alias("metres"))


def st_dwithin_filter(spark, d):
    return geo.dwithin_filter(_places(spark, d, "customer", "c_custkey"), "c_custkey_x", "c_custkey_y", 10.0, 45.0, 2_000_000.0).select("c_custkey")


def st_dwithin_join(spark, d):
    return geo.dwithin_join(_places(spark, d, "customer", "c_custkey"), "c_custkey_x", "c_custkey_y", _places(spark, d, "supplier", "s_suppkey"), "s_suppkey_x", "s_suppkey_y", 400_000.0).select("c_custkey", "s_suppkey")


def st_within(spark, d):
    box = geo.st_literal("POLYGON((-100 -40, -60 50, 120 60, 80 -50, -100 -40))")
    c = _places(spark, d, "customer", "c_custkey")
    return c.where(geo.st_within(geo.st_point("c_custkey_x", "c_custkey_y"), box)).select("c_custkey")


def st_area_length(spark, d):
    c = _places(spark, d, "supplier", "s_suppkey")
    x, y = F.col("s_suppkey_x"), F.col("s_suppkey_y")
    num = lambda v: v.cast("string")
    pair = lambda a, b: F.concat(num(a), F.lit(" "), num(b))
    poly = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", pair(x, y), pair(x + 2, y), pair(x + 2, y + 3), pair(x, y + 3), pair(x, y)), F.lit("))"))
    line = F.concat(F.lit("LINESTRING("), F.concat_ws(", ", pair(x, y), pair(x + 1, y), pair(x + 1, y + 1)), F.lit(")"))
    rows = c.select("s_suppkey", geo.st_parse(poly).alias("p"), geo.st_parse(line).alias("l"))
    return rows.select("s_suppkey", F.round(geo.st_area("p"), 6).alias("area"), F.round(geo.st_length("l"), 3).alias("metres"), F.round(geo.st_x("p"), 6).alias("cx"), geo.st_dimension("p").cast("long").alias("dim"))


def st_transform(spark, d):
    c = _places(spark, d, "customer", "c_custkey")
    m = geo.st_transform(geo.st_point("c_custkey_x", "c_custkey_y", srid=4326), 3857)
    return c.select("c_custkey", (F.round(geo.st_x(m), 3) + 0.0).alias("x"), (F.round(geo.st_y(m), 3) + 0.0).alias("y"))


def st_intersects_join(spark, d):
    def boxes(table, key, w):
        x, y = F.col(f"{key}_x"), F.col(f"{key}_y")
        p = lambda a, b: F.struct(a.alias("x"), b.alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("t"))
        g = F.struct(F.lit(0).alias("srid"), F.lit("LINESTRING").alias("kind"), F.array(F.array(p(x, y), p(x + w, y + w))).alias("rings"))
        return _places(spark, d, table, key).select(key, g.alias(f"g_{key}"))

    return geo.intersects_join(boxes("customer", "c_custkey", 2.0), "g_c_custkey", boxes("supplier", "s_suppkey", 3.0), "g_s_suppkey", 10.0).select("c_custkey", "s_suppkey")


def grid_cluster(spark, d):
    out = geo.cluster_grid(_places(spark, d, "customer", "c_custkey"), "c_custkey_x", "c_custkey_y", 30.0)
    return out.select("i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "members")


def kernel_density(spark, d):
    out = geo.kernel_density(_places(spark, d, "supplier", "s_suppkey"), "s_suppkey_x", "s_suppkey_y", -180.0, -90.0, 60.0, 6, 3, 25.0)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("density", 6).alias("density"))


def raster_value(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", raster.set_value(raster.make_empty(4, 3, 0, 0, 1, 1), F.col("s_suppkey") % 4, F.lit(1), F.col("s_acctbal")).alias("r"))
    return s.select("s_suppkey", raster.value("r", F.col("s_suppkey") % 4, 1).alias("v"), raster.value("r", 0, 9).alias("out"), raster.width("r").cast("long").alias("w"))


# ---------------------------------------------------------------- tables and agents


def upsert(spark, d):
    o = load(spark, d, "orders")
    return tables.upsert(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


def update_delete(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.delete_where(tables.update_where(o, "o_orderstatus = 'F'", o_totalprice="o_totalprice * 2", o_orderstatus="'D'"), "o_totalprice < 50000")


def analyze_stats(spark, d):
    return tables.analyze(load(spark, d, "nation"))


def value_histogram(spark, d):
    return tables.value_histogram(load(spark, d, "part"), "p_brand", 10)


def row_checksum_verify(spark, d):
    c = load(spark, d, "customer")
    changed = c.where("c_custkey % 10 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return tables.verify_copy(c, changed, ["c_custkey"]).select("c_custkey", "problem")


def agent_recall(spark, d):
    m = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.concat(F.lit("a"), F.col("label")).alias("agent_id"), F.lit("semantic").alias("tier"), F.concat(F.lit("m"), F.col("vec_id")).alias("content"), "embedding", "q")
    return agent.recall_semantic(m, "a3", F.col("q"), 5).select("id", "content", (F.round("distance", 6) + 0.0).alias("distance"))


def agent_metrics(spark, d):
    m = _metrics(spark, d).select(F.col("user_id").alias("agent_id"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), "ts")
    return agent.success_rate(m).select("agent_id", F.round("success_rate", 6).alias("success_rate"))


def latency_rollup(spark, d):
    m = _metrics(spark, d).select(F.col("user_id").alias("agent_id"), F.col("value").alias("latency_ms"), "ts")
    return agent.latency_rollup(m, "1 day").select("agent_id", "bucket", "count", "min", "max")


def _log_of_turns(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    log = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("turn").alias("ts"), F.col("role").alias("actor"), F.lit("say").alias("action"), F.char_length("text").cast("string").alias("details"))
    return log.dropDuplicates(["session_id", "seq"])


def audit_chain(spark, d):
    return agent.audit_chain(_log_of_turns(spark, d)).select("session_id", "seq", "prev_hash", "hash")


def session_replay(spark, d):
    t = load(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("evt_offset"), "role", F.lit(None).cast("string").alias("error"))
    return agent.replay_up_to(t, "3", 4).select("session_id", "evt_offset", "role")


def provenance_latest(spark, d):
    f = _metrics(spark, d).select(F.col("user_id").alias("fact_ref"), F.col("event_type").alias("source"), F.lit(1.0).alias("confidence"), F.col("event_id").alias("seq"), "ts")
    return agent.provenance_latest(f).select("fact_ref", "source", "seq", "ts")


def shared_state(spark, d):
    u = _metrics(spark, d).select(F.col("event_type").alias("workflow"), (F.col("event_id") % 5).alias("key"), F.col("value"), F.col("user_id").alias("updated_by"), F.col("event_id").alias("updated_at"))
    return agent.shared_state(u)


QUERIES = {f.__name__: f for f in (
    time_bucket, time_bucket_range, rollup, rollup_retention, moving_average, interpolate, gap_fill, gap_fill_all, lag_by_row, ntile_formula,
    json_arrow, json_typeof_valid, json_contains, json_build_set, json_path_lookup, pipeline_group, pipeline_project, fts_and, bm25,
    l2_topk, cosine_topk, dot_product, hybrid_rrf, tumbling, sliding, sliding_sparse, session, session_by_key, time_travel, cdc_diff, topic_retention,
    graph_neighbors, graph_bfs, graph_shortest_path, graph_components, graph_pagerank, graph_triangles, graph_labels, graph_match_2hop,
    graph_bfs_all, graph_shortest_path_all, graph_components_all, graph_pagerank_all, graph_triangles_all, graph_labels_all,
    st_distance, st_dwithin_filter, st_dwithin_join, st_within, st_area_length, st_transform, st_intersects_join, grid_cluster, kernel_density, raster_value,
    upsert, update_delete, analyze_stats, value_histogram, row_checksum_verify, agent_recall, agent_metrics, latency_rollup, audit_chain, session_replay, provenance_latest, shared_state,
)}

_BM = f"""
t AS (SELECT doc_id, {TOKENS} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM t),
q AS (SELECT * FROM (VALUES %s) v(w, times)),
tf AS (SELECT doc_id, len(ws) AS dl, w, times, len(list_filter(ws, lambda x: x = w)) AS tf FROM t, q),
df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w),
b AS (SELECT doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM tf JOIN df USING (w), s WHERE tf > 0 GROUP BY doc_id)
"""
_L2 = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))))"
_DOT = "list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"
_N1, _N2 = (f"sqrt(list_sum(list_transform({c}, lambda v: CAST(v AS DOUBLE) * v)))" for c in ("embedding", "q"))
_V = "v AS (SELECT vec_id, label, embedding, q FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))"
_PR = ", ".join(
    f"p{i} AS (SELECT n.v, 0.15 / cnt + 0.85 * coalesce(g.got, 0) + 0.85 * coalesce((SELECT sum(s) FROM p{i - 1} WHERE v NOT IN (SELECT src FROM e)), 0) / cnt AS s FROM n CROSS JOIN (SELECT count(*) AS cnt FROM n) LEFT JOIN (SELECT dst, sum(s * 1.0 / deg) AS got FROM e JOIN (SELECT src, count(*) AS deg FROM e GROUP BY src) USING (src) JOIN p{i - 1} ON v = src GROUP BY dst) g ON g.dst = n.v)"
    for i in (1, 2, 3)
)

# Over all edges, with the operators' default iterations.
_BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_WALK = "w(v, depth) AS (SELECT DISTINCT src, 0 FROM b WHERE src = 'c1' UNION SELECT dst, depth + 1 FROM w JOIN b ON src = v WHERE depth < 10)"
_PR_ALL = ", ".join(
    f"p{i} AS MATERIALIZED (SELECT n.v, 0.15 / cnt + 0.85 * coalesce(g.got, 0) + 0.85 * coalesce((SELECT sum(s) FROM p{i - 1} WHERE v NOT IN (SELECT src FROM o)), 0) / cnt AS s FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(s / deg) AS got FROM e JOIN o USING (src) JOIN p{i - 1} ON v = src GROUP BY dst) g ON g.dst = n.v)"
    for i in range(1, 21)
)
_LABELS_ALL = ", ".join(
    f"l{i} AS MATERIALIZED (SELECT src AS v, label FROM (SELECT src, label, count(*) AS n FROM u JOIN l{i - 1} ON v = dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1)" for i in range(1, 11)
)

ORACLE_SQL = {
    "time_bucket": f"WITH {METRICS} SELECT ts - ts % {DAY} AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY 1, 2 HAVING count(*) > 2",
    "time_bucket_range": f"WITH {METRICS} SELECT event_id, ts FROM m WHERE ts - ts % {DAY} = 1704153600000",
    "rollup": f"WITH {METRICS} SELECT event_type, ts - ts % {6 * HOUR} AS bucket, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM m GROUP BY 1, 2",
    "rollup_retention": f"WITH {METRICS} SELECT event_id, ts FROM m WHERE ts - ts % {HOUR} + {HOUR} > (SELECT max(ts) FROM m) - {2 * DAY}",
    "moving_average": f"WITH {METRICS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS ma FROM m",
    "interpolate": f"""WITH {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM m),
 k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS lr, last_value(value IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS hr, first_value(value IGNORE NULLS) OVER a AS hv FROM r
 WINDOW b AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN lv IS NOT NULL AND hv IS NOT NULL THEN lv + (hv - lv) * (rn - lr) / (hr - lr) ELSE coalesce(lv, hv) END, 6) AS filled FROM k""",
    "gap_fill": f"WITH {METRICS}, b AS (SELECT ts - ts % {6 * HOUR} AS bucket, count(*) AS n FROM m GROUP BY 1), g AS (SELECT unnest(range(a, z + 1, {6 * HOUR})) AS bucket FROM (SELECT min(bucket) AS a, max(bucket) AS z FROM b)) SELECT g.bucket, n FROM g LEFT JOIN b ON g.bucket = b.bucket",
    "gap_fill_all": f"WITH {METRICS}, b AS (SELECT ts - ts % 60000 AS bucket, count(*) AS n FROM m GROUP BY 1), g AS (SELECT unnest(range(a, z + 1, 60000)) AS bucket FROM (SELECT min(bucket) AS a, max(bucket) AS z FROM b)) SELECT g.bucket, coalesce(n, 0) AS n, n IS NULL AS gap FROM g LEFT JOIN b ON g.bucket = b.bucket",
    "lag_by_row": f"WITH {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM m) SELECT a.event_id, b.event_id AS lagged FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = a.rn - a.event_id % 3",
    "ntile_formula": "SELECT c_custkey, CAST(least(4, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1) * 4 // count(*) OVER (PARTITION BY c_mktsegment) + 1) AS BIGINT) AS tile FROM customer",
    "json_arrow": "SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS j, props ->> '$.k' AS t, props ->> '$.missing' AS none FROM events",
    "json_typeof_valid": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'array' WHEN 1 THEN 'string' WHEN 2 THEN NULL ELSE 'object' END AS kind, event_id % 5 <> 2 AS ok, CASE WHEN event_id % 5 = 0 THEN 2 END AS n FROM events",
    "json_contains": "SELECT o_orderkey, o_orderstatus = 'F' AS hit FROM orders",
    "json_build_set": """SELECT o_orderkey, '{"extra":{"n":5},"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS j FROM orders""",
    "json_path_lookup": "SELECT event_id FROM events WHERE props ->> '$.k' = '87'",
    "pipeline_group": "SELECT o_orderpriority AS _id, round(sum(o_totalprice), 2) AS total, CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'P' GROUP BY 1",
    "pipeline_project": "SELECT o_orderkey, o_totalprice AS price, 'top' AS tag FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 3",
    "fts_and": f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS ws FROM documents) WHERE list_contains(ws, 'the') AND list_contains(ws, 'and') AND list_contains(ws, 'of')",
    "bm25": "WITH " + _BM % "('license', 2), ('the', 1), ('password', 1)" + "SELECT doc_id, round(score, 6) AS score FROM b",
    "l2_topk": f"WITH {_V}, x AS (SELECT vec_id, {_L2} AS far FROM v) SELECT vec_id, round(far, 6) + 0.0 AS distance FROM x ORDER BY far, vec_id LIMIT 10",
    "cosine_topk": f"WITH {_V}, x AS (SELECT vec_id, 1 - {_DOT} / ({_N1} * {_N2}) AS far FROM v) SELECT vec_id, round(far, 6) + 0.0 AS distance FROM x ORDER BY far, vec_id LIMIT 10",
    "dot_product": f"WITH {_V} SELECT vec_id, round({_DOT}, 6) + 0.0 AS dot, CAST(len(embedding) AS BIGINT) AS dims FROM v",
    "hybrid_rrf": f"""WITH {_V}, x AS (SELECT vec_id AS doc_id, {_L2} AS far FROM v), j AS (SELECT doc_id, text, far FROM documents JOIN x USING (doc_id)),
""" + (_BM % "('license', 1), ('password', 1)").replace("FROM documents", "FROM j") + """,
 a AS (SELECT doc_id, far, row_number() OVER (ORDER BY far, doc_id) AS r FROM j QUALIFY r <= 50), c AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b QUALIFY r <= 50),
 f AS (SELECT doc_id, far, score, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + c.r), 0) AS fused FROM a FULL JOIN c USING (doc_id))
 SELECT doc_id, round(far, 6) AS vec_distance, round(score, 6) AS bm25_score, round(fused, 8) AS fused_score FROM f ORDER BY fused DESC, doc_id LIMIT 10""",
    "tumbling": f"WITH {METRICS} SELECT ts - ts % {6 * HOUR} AS window_start, ts - ts % {6 * HOUR} + {6 * HOUR} AS window_end, count(*) AS count FROM m GROUP BY 1, 2",
    "sliding": f"WITH {METRICS}, w AS (SELECT ts, unnest(range(ts - ts % {4 * HOUR} + {4 * HOUR}, ts + {10 * HOUR} + 1, {4 * HOUR})) AS e FROM m) SELECT e - {10 * HOUR} AS window_start, e AS window_end, count(*) AS count FROM w GROUP BY e",
    "sliding_sparse": f"WITH {METRICS}, w AS (SELECT ts, ts - ts % {5 * HOUR} + {5 * HOUR} AS e FROM m) SELECT e - {HOUR} AS window_start, e AS window_end, count(*) AS count FROM w WHERE ts >= e - {HOUR} GROUP BY e",
    "session": f"WITH {METRICS}, s AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= 600000 THEN 0 ELSE 1 END AS f FROM m), g AS (SELECT ts, sum(f) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT min(ts) AS window_start, max(ts) AS window_end, count(*) AS count FROM g GROUP BY k",
    "session_by_key": f"WITH {METRICS}, s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= {6 * HOUR} THEN 0 ELSE 1 END AS f FROM m), g AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id AS key, min(ts) AS window_start, max(ts) AS window_end, count(*) AS count FROM g GROUP BY user_id, k",
    "time_travel": f"WITH {METRICS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM m WHERE ts <= 1704844800000) SELECT user_id AS row_key, '{{\"event_id\":' || event_id || '}}' AS data FROM l WHERE r = 1 AND event_type <> 'error'",
    "cdc_diff": "WITH o AS (SELECT o_orderkey, round(o_totalprice, 2) AS p FROM orders), b AS (SELECT * FROM o WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE p END AS p FROM o WHERE o_orderkey % 7 <> 0) SELECT o_orderkey, CASE WHEN b.p IS NULL THEN 'insert' WHEN a.p IS NULL THEN 'delete' ELSE 'update' END AS op, b.p AS old, a.p AS new FROM b FULL JOIN a USING (o_orderkey) WHERE b.p IS NULL OR a.p IS NULL OR a.p <> b.p",
    "topic_retention": f"WITH {METRICS}, t AS (SELECT user_id % 4 AS partition, event_id AS o, event_id % 9 + 1 AS size, ts, max(ts) OVER (PARTITION BY user_id % 4) AS newest FROM m), s AS (SELECT partition, o, sum(size) OVER (PARTITION BY partition ORDER BY o DESC ROWS UNBOUNDED PRECEDING) AS total FROM t WHERE ts >= newest - {20 * DAY}) SELECT partition, o AS \"offset\" FROM s WHERE total <= 500",
    "graph_neighbors": f"WITH {EDGES} SELECT dst AS neighbor, rel FROM e WHERE src = 'c1'",
    "graph_bfs": f"WITH RECURSIVE {RING}, w(v, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = v WHERE depth < 4) SELECT v AS vertex, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY v",
    "graph_shortest_path": f"WITH RECURSIVE {TREE}, a(v, s) AS (SELECT CAST(100 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT dst, s + 1 FROM a JOIN e ON src = v WHERE src <> dst), b(v, s) AS (SELECT CAST(141 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT dst, s + 1 FROM b JOIN e ON src = v WHERE src <> dst), m AS (SELECT a.s AS up, b.s AS down FROM a JOIN b ON a.v = b.v ORDER BY a.s LIMIT 1) SELECT a.s AS step, a.v AS vertex FROM a, m WHERE a.s <= up UNION ALL SELECT up + down - b.s, b.v FROM b, m WHERE b.s < down",
    "graph_components": f"WITH RECURSIVE {TREE}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(v, c) AS (SELECT src, src FROM b UNION SELECT dst, c FROM w JOIN b ON src = v) SELECT v AS vertex, min(c) AS component FROM w GROUP BY v",
    "graph_pagerank": f"WITH {RING}, n AS (SELECT src AS v FROM e UNION SELECT dst FROM e), p0 AS (SELECT v, 1.0 / (SELECT count(*) FROM n) AS s FROM n), {_PR} SELECT v AS vertex, round(s, 9) AS score FROM p3",
    "graph_triangles": f"WITH {RING}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT unnest([p, q, r]) AS v FROM t), n AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT n.v AS vertex, count(c.v) AS triangles FROM n LEFT JOIN c ON n.v = c.v GROUP BY n.v",
    "graph_labels": f"WITH {RING}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), c AS (SELECT src, dst AS label, count(*) AS n FROM b GROUP BY 1, 2) SELECT src AS vertex, arg_min(label, -n * 1000 + label) AS label FROM c GROUP BY src",
    "graph_bfs_all": f"WITH RECURSIVE {EDGES}, {_BOTH}, {_WALK} SELECT v AS vertex, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY v",
    "graph_shortest_path_all": f"WITH RECURSIVE {EDGES}, {_BOTH}, {_WALK}, m AS (SELECT v, min(depth) AS depth FROM w GROUP BY v), f AS (SELECT m.v, m.depth, min(b.src) AS before FROM m LEFT JOIN (b JOIN m m2 ON m2.v = b.src) ON b.dst = m.v AND m2.depth = m.depth - 1 GROUP BY 1, 2), p AS (SELECT v, depth, before FROM f WHERE v = 'c2' UNION ALL SELECT f.v, f.depth, f.before FROM p JOIN f ON f.v = p.before) SELECT CAST(depth AS BIGINT) AS step, v AS vertex FROM p",
    "graph_components_all": f"WITH RECURSIVE {EDGES}, {_BOTH}, w(v, c) AS (SELECT src, src FROM b UNION SELECT dst, c FROM w JOIN b ON src = v) SELECT v AS vertex, min(c) AS component FROM w GROUP BY v",
    "graph_pagerank_all": f"WITH {EDGES}, n AS (SELECT src AS v FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS cnt FROM n), o AS (SELECT src, CAST(count(*) AS DOUBLE) AS deg FROM e GROUP BY src), p0 AS (SELECT v, CAST(1.0 AS DOUBLE) / cnt AS s FROM n, c), {_PR_ALL} SELECT v AS vertex, round(s, 9) AS score FROM p20",
    "graph_triangles_all": f"WITH {TRIPLES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT unnest([p, q, r]) AS v FROM t), n AS (SELECT src AS v FROM e UNION SELECT dst FROM e), h AS (SELECT v, count(*) AS t FROM c GROUP BY v) SELECT n.v AS vertex, coalesce(t, 0) AS triangles FROM n LEFT JOIN h ON n.v = h.v",
    "graph_labels_all": f"WITH {EDGES}, u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT DISTINCT src AS v, src AS label FROM u), {_LABELS_ALL} SELECT v AS vertex, label FROM l10",
    "graph_match_2hop": f"WITH {EDGES} SELECT x.src AS a, y.src AS c FROM e x JOIN e y ON x.dst = y.dst WHERE x.rel[1] = '1' AND y.rel[1] = '5' AND x.src = 'c1'",
    "st_distance": f"SELECT c_custkey, round({_haversine('c_custkey_x', 'c_custkey_y', '2.3522', '48.8566')}, 3) AS metres FROM {CP}",
    "st_dwithin_filter": f"SELECT c_custkey FROM {CP} WHERE {_haversine('c_custkey_x', 'c_custkey_y', '10.0', '45.0')} <= 2000000",
    "st_dwithin_join": f"SELECT c_custkey, s_suppkey FROM {CP} c JOIN {SP} s ON {_haversine('c_custkey_x', 'c_custkey_y', 's_suppkey_x', 's_suppkey_y')} <= 400000",
    "st_within": f"WITH ring AS (SELECT * FROM (VALUES (-100.0, -40.0, -60.0, 50.0), (-60.0, 50.0, 120.0, 60.0), (120.0, 60.0, 80.0, -50.0), (80.0, -50.0, -100.0, -40.0)) v(x1, y1, x2, y2)), h AS (SELECT c_custkey, count(*) AS n FROM {CP}, ring WHERE (y1 > c_custkey_y) <> (y2 > c_custkey_y) AND c_custkey_x < (x1 - x2) * (c_custkey_y - y2) / (y1 - y2) + x2 GROUP BY 1) SELECT c_custkey FROM h WHERE n % 2 = 1",
    "st_area_length": f"SELECT s_suppkey, 6.0 AS area, round({_haversine('s_suppkey_x', 's_suppkey_y', 's_suppkey_x + 1', 's_suppkey_y')} + {_haversine('s_suppkey_x + 1', 's_suppkey_y', 's_suppkey_x + 1', 's_suppkey_y + 1')}, 3) AS metres, round(s_suppkey_x + 0.8, 6) AS cx, CAST(2 AS BIGINT) AS dim FROM {SP}",
    "st_transform": f"SELECT c_custkey, round(radians(c_custkey_x) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(greatest(least(c_custkey_y, 85.05112878), -85.05112878)) / 2)) * 6378137.0, 3) + 0.0 AS y FROM {CP}",
    "st_intersects_join": f"SELECT c_custkey, s_suppkey FROM {CP} c JOIN {SP} s ON c_custkey_x <= s_suppkey_x + 3 AND s_suppkey_x <= c_custkey_x + 2 AND c_custkey_y <= s_suppkey_y + 3 AND s_suppkey_y <= c_custkey_y + 2",
    "grid_cluster": f"SELECT CAST(floor(c_custkey_x / 30) AS BIGINT) AS i, CAST(floor(c_custkey_y / 30) AS BIGINT) AS j, round(avg(c_custkey_x), 6) AS x, round(avg(c_custkey_y), 6) AS y, count(*) AS members FROM {CP} GROUP BY 1, 2",
    "kernel_density": f"WITH g AS (SELECT i, j, sum(exp(-(pow(s_suppkey_x - (-180 + i * 60), 2) + pow(s_suppkey_y - (-90 + j * 60), 2)) / 1250)) AS s FROM {SP}, range(6) a(i), range(3) b(j) GROUP BY 1, 2) SELECT i, j, round(s / (SELECT max(s) FROM g), 6) AS density FROM g",
    "raster_value": "SELECT s_suppkey, s_acctbal AS v, CAST(NULL AS DOUBLE) AS out, CAST(4 AS BIGINT) AS w FROM supplier",
    "upsert": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "update_delete": "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders) WHERE o_totalprice >= 50000",
    "analyze_stats": "SELECT 'n_nationkey' AS \"column\", count(*) AS rows, count(DISTINCT n_nationkey) AS \"distinct\" FROM nation UNION ALL SELECT 'n_name', count(*), count(DISTINCT n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(DISTINCT n_regionkey) FROM nation",
    "value_histogram": "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "row_checksum_verify": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM customer WHERE c_custkey % 10 = 0 OR (c_custkey % 9 = 0 AND c_acctbal <> 0)",
    "agent_recall": f"WITH {_V}, x AS (SELECT vec_id, 1 - {_DOT} / ({_N1} * {_N2}) AS far FROM v WHERE label = 3) SELECT vec_id AS id, 'm' || vec_id AS content, round(far, 6) + 0.0 AS distance FROM x ORDER BY far, vec_id LIMIT 5",
    "agent_metrics": "SELECT user_id AS agent_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY 1",
    "latency_rollup": f"WITH {METRICS} SELECT user_id AS agent_id, ts - ts % {DAY} AS bucket, count(value) AS count, min(value) AS min, max(value) AS max FROM m GROUP BY 1, 2",
    "audit_chain": "WITH RECURSIVE r AS (SELECT conv_id, turn, '|' || turn || '|' || turn || '|' || role || '|say|' || length(text) AS entry, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), w AS (SELECT conv_id, turn, k, '' AS prev_hash, sha256(entry) AS hash FROM r WHERE k = 1 UNION ALL SELECT r.conv_id, r.turn, r.k, w.hash, sha256(w.hash || r.entry) FROM w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1) SELECT conv_id AS session_id, turn AS seq, prev_hash, hash FROM w",
    "session_replay": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS evt_offset, role FROM conversations WHERE conv_id = 3 AND turn <= 4",
    "provenance_latest": f"WITH {METRICS} SELECT user_id AS fact_ref, event_type AS source, event_id AS seq, ts FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "shared_state": f"WITH {METRICS} SELECT event_type AS workflow, event_id % 5 AS key, value, user_id AS updated_by, event_id AS updated_at FROM m QUALIFY row_number() OVER (PARTITION BY event_type, event_id % 5 ORDER BY event_id DESC) = 1",
}
