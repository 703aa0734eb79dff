"""Queries of sources, sinks, declared tables, topics, documents, geometry, grids, agents and table functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.register import create_function
from ..operators import agent, ddl, document, geo, graph, raster, tables, text, timeseries, vector
from ..session import load, prepare, views
from ..shared import new_folder, stored
from ..sources import files
from ..streaming import topics, windows
from .builder import Query
from .domain import DAY, EDGES, METRICS, _edges, _metrics, _places, _places_sql, _V, _vectors
from .sqlfront import sql

CP = _places_sql("customer", "c_custkey")


# ---------------------------------------------------------------- files


def copy_round_trip(spark, d):
    """Texts with line ends, tabs and backslashes, and nulls, through tab text and back."""
    t = F.when(F.col("doc_id") % 7 != 0, F.concat(F.col("text"), F.lit("\t\\t\\\\n\r\n\\N")))
    rows, path = load(prepare(spark), d, "documents").select("doc_id", t.alias("text")), new_folder(spark, "copy")
    files.write_copy(rows, path)
    return files.read_copy(spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("digest"))


def csv_round_trip(spark, d):
    rows, path = load(spark, d, "customer").select("c_custkey", F.concat(F.lit('a "quoted", '), "c_name").alias("name"), "c_acctbal"), new_folder(spark, "csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "c_custkey long, name string, c_acctbal double")


def json_round_trip(spark, d):
    rows, path = load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"), "p_size"), new_folder(spark, "json")
    files.write_json(rows, path)
    return files.read_json(spark, path, "p_partkey long, name string, p_size long")


def migrate_changed(spark, d):
    """What differs after a copy whose source went on changing: rows of the new state against the copy."""
    from ..operators.tables import verify_copy

    c, path = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), new_folder(spark, "moved")
    assert not files.migrate(c, path, ["c_custkey"]).count()
    now = c.where("c_custkey > 5").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal")))
    return verify_copy(now, spark.read.parquet(path), ["c_custkey"])


MAPPED = [("postgres", "int8"), ("postgres", "_text"), ("postgis", "geometry"), ("postgis", "float8"), ("mysql", "tinyint(1)"), ("mysql", "tinyint(4)"), ("mysql", "unsigned bigint"), ("mssql", "money"), ("oracle", "NUMBER(10,2)"), ("odbc", "-7"), ("odbc", "93"), ("mongodb", "long"), ("elasticsearch", "date"), ("influxdb", "float"), ("neo4j", "Integer"), ("kafka", "int32")]


def type_map(spark, d):
    return spark.createDataFrame([(s, t, files.map_type(s, t)) for s, t in MAPPED], "system string, name string, mapped string")


def catalog_columns(spark, d):
    views(prepare(spark), d, "orders", "nation")
    return files.information_schema_columns(spark).where("table_name IN ('orders', 'nation')").select("table_name", "column_name", F.col("ordinal_position").cast("long").alias("place"))


# ---------------------------------------------------------------- declared tables


def insert_defaults(spark, d):
    t = ddl.Table(prepare(spark), new_folder(spark, "tables"), "c", "k long, name string, seg string, n long", primary_key=["k"], defaults={"seg": "NONE", "n": 7})
    c = load(spark, d, "customer")
    t.insert(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    t.update("k % 2 = 0", n="n + 1", seg="'EVEN'")
    t.delete("k % 5 = 0")
    return t.read()


def alter_table(spark, d):
    t = ddl.Table(prepare(spark), new_folder(spark, "tables"), "n", "k long, name string", primary_key=["k"])
    t.insert(load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))
    t.add_column("tag", "string", "new")
    t.drop_column("name")
    t.set_default("tag", "later")
    t.insert(load(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("k")))
    return t.read()


def constraint_checks(spark, d):
    """Rows of a bad batch by what they break."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    bad = o.select(F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") / 2).cast("long")).alias("k"), F.when(F.col("o_orderkey") % 4 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("c"))
    parts = [("not null", tables.not_null_violations(bad, ["k"])), ("unique", tables.unique_violations(bad, ["k"])), ("reference", tables.fk_violations(bad, "c", load(spark, d, "customer"), "c_custkey"))]
    out = None
    for what, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def json_schema_check(spark, d):
    schema = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer", "maximum": 50}}}
    return load(spark, d, "events").select("event_id", F.size(document.validate_json("props", schema)).cast("long").alias("broken"))


def sequence_ids(spark, d):
    s = tables.Sequence(100, 2)
    return s.assign(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "id", "c_acctbal", "c_custkey").select("c_custkey", "id")


def analyze_orders(spark, d):
    return tables.analyze(load(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"))


# ---------------------------------------------------------------- topics


def _topic(spark, d) -> topics.Topic:
    t = topics.Topic(spark, new_folder(spark, "topics"), "events")
    t.publish(_metrics(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("timestamp_ms")))
    return t


def topic_scan(spark, d):
    return _topic(spark, d).read().select("partition", "offset", "key", "value", "timestamp_ms").withColumn("partition", F.col("partition").cast("long"))


def topic_poll(spark, d):
    t = _topic(spark, d)
    t.commit("g", 0, 5)
    t.commit("g", 0, 10)
    return topics.Topic(spark, t.path.rsplit("/", 1)[0], "events").poll("g", 0, 20).select("offset", "value")


def stream_windows(spark, d):
    """Live windows over a topic's folder, until all of it is read."""
    t, name = _topic(spark, d), new_folder(spark, "counts").rsplit("/", 1)[1].replace("-", "_")
    live = windows.stream_tumbling(topics.read_stream(spark, t.path), "6 hours", "1 hour")
    q = live.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.unix_millis("start").alias("window_start"), F.unix_millis("end").alias("window_end"), "count")


def rollup_query(spark, d):
    return timeseries.rollup_query(_metrics(spark, d), "1 day", "ts", "value", 1_704_153_600_000, 1_704_500_000_000).select("bucket", "count", F.round("sum", 4).alias("sum"), "min", "max")


# ---------------------------------------------------------------- SQL front


def param_query(spark, d):
    views(prepare(spark), d, "orders")
    return sql(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $2 AND o_totalprice > $1 AND o_orderstatus <> $3", [50_000, "F", "P"])


def query_builder(spark, d):
    views(prepare(spark), d, "part")
    return Query("part").select("p_partkey", "p_name").filter_eq("p_size", 7).order_by("p_partkey", False).limit(1000).run(spark)


def user_function(spark, d):
    views(prepare(spark), d, "customer")
    create_function(spark, "twice_less_one", "int8", lambda s: s * 2 - 1)
    return spark.sql("SELECT c_custkey, twice_less_one(c_custkey) AS x FROM customer")


def tvf_graph(spark, d):
    _edges(spark, d).createOrReplaceTempView("edges_cs")
    return sql(spark, "SELECT b.vertex, b.depth + 0L AS depth FROM graph_bfs('edges_cs', 'src', 'c1', 2, 'both') b WHERE b.depth > 0")


def tvf_vector(spark, d):
    load(prepare(spark), d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").createOrReplaceTempView("vecs")
    q = "[" + ",".join(["1"] * 64) + "]"
    return sql(spark, f"SELECT id, round(distance, 6) + 0.0D AS distance FROM vector_search('vecs', 'embedding', '{q}', 7)")


def tvf_windows(spark, d):
    _metrics(spark, d).select(F.col("ts").alias("timestamp_ms")).createOrReplaceTempView("log_ts")
    return sql(spark, f"SELECT t.window_start, t.count AS n, s.count AS wide FROM flux_window_tumbling('log_ts', {DAY}) t JOIN flux_window_sliding('log_ts', {2 * DAY}, {DAY}) s ON t.window_end = s.window_end")


def tvf_pipeline(spark, d):
    views(prepare(spark), d, "orders")
    return sql(spark, """SELECT _id AS status, n FROM aggregate_pipeline('orders', '[{"$match":{"o_totalprice":{"$gte":1000}}},{"$group":{"_id":"$o_orderstatus","n":{"$sum":1}}}]')""")


def match_text(spark, d):
    _edges(spark, d).withColumn("rel", F.concat(F.lit("R"), F.substring("rel", 1, 1))).withColumnRenamed("dst", "to_id").createOrReplaceTempView("edges_m")
    return sql(spark, "MATCH (a)-[:R2]->(b) ON edges_m(src) WHERE a = 'c2' RETURN a, b")


# ---------------------------------------------------------------- documents


def _nested(spark, d) -> DataFrame:
    o = load(prepare(spark), d, "orders")
    inner = F.to_json(F.struct(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus").alias("b"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    return o.select("o_orderkey", F.concat(F.lit('{"a":'), inner, F.lit("}")).alias("j"))


def json_paths(spark, d):
    _nested(spark, d).createOrReplaceTempView("nested_j")
    return sql(spark, "SELECT o_orderkey, j #> '{a,b,1}' AS quoted, j #>> '{a,b,0}' AS plain, j -> 'a' -> 'b' AS list, j #> '{a,none}' AS gone, j #>> '{a,b,9}' AS out FROM nested_j")


def json_contains_rows(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    have, probe = F.to_json(F.array(k % 3, k % 5)), F.to_json(F.array(k % 4))
    return o.select("o_orderkey", document.json_contains(have, probe).alias("hit"))


def json_set_cases(spark, d):
    j = F.concat(F.lit('{"k":'), F.col("o_orderkey").cast("string"), F.lit(',"v":[1,2]}'))
    o = load(spark, d, "orders").select("o_orderkey", j.alias("j"))
    return o.select("o_orderkey", document.json_set("j", ["none"], 1, create=False).alias("kept"), document.json_set("j", ["v", "5"], 3).alias("added"), document.json_set("j", ["v", "0"], 9).alias("changed"))


def json_text_search(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("building"), "c_name")).alias("j"))
    return text.text_search(c, "c_custkey", "j", "Building", is_json=True)


def flatten_json_all(spark, d):
    return document.flatten_json(load(spark, d, "events").select("event_id", "props"), "event_id", "props").select("event_id", F.col("depth").cast("long").alias("depth"), "path", "value", "is_leaf")


def pipeline_first_push(spark, d):
    stages = [{"$match": {"o_orderstatus": {"$in": ["F", "O"]}, "o_orderpriority": {"$nin": ["5-LOW"]}}}, {"$sort": {"o_orderpriority": -1, "o_orderkey": 1}}, {"$group": {"_id": {"s": "$o_orderstatus", "c": "$o_custkey"}, "top": {"$first": "$o_orderpriority"}, "keys": {"$push": "$o_orderkey"}}}]
    out = document.run_pipeline(load(spark, d, "orders"), stages)
    return out.select(F.col("_id").alias("id"), "top", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


def pipeline_literal_id(spark, d):
    out = document.run_pipeline(load(spark, d, "orders"), [{"$group": {"_id": "all", "twice": {"$sum": 2}, "low": {"$min": "$o_totalprice"}}}])
    return out.select(F.col("_id").alias("id"), "twice", "low")


# ---------------------------------------------------------------- geometry


def _spread(rows, key):
    """Dealt by key: a small file is one input split, and forms are made row by row in Python."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def st_forms(spark, d):
    """Text, EWKT and binary forms of points with z and m."""
    c = _spread(_places(spark, d, "customer", "c_custkey"), "c_custkey")
    x, y, k = F.col("c_custkey_x"), F.col("c_custkey_y"), F.col("c_custkey")
    flat, zm, m = geo.st_point(x, y, srid=4326), geo.st_point(x, y, k, k + 1), geo.st_parse(F.concat(F.lit("POINT M("), x.cast("int").cast("string"), F.lit(" "), y.cast("int").cast("string"), F.lit(" 5)")))
    rows = c.select("c_custkey", flat.alias("f"), zm.alias("z"), m.alias("m"))
    back = geo.st_from_wkb(geo.st_as_ewkb("z"))
    return rows.select(
        "c_custkey", geo.st_as_ewkt("f").alias("ewkt"), geo.st_as_text("z").alias("wkt"), geo.st_as_text(back).alias("back"), geo.st_as_text("m").alias("measured"),
        geo.st_z("z").alias("z"), geo.st_t("m").alias("t"), geo.st_srid("f").cast("long").alias("srid"), geo.st_srid(geo.st_set_srid(F.col("f"), 3857)).cast("long").alias("set"),
    )


def st_shapes(spark, d):
    c = _spread(_places(spark, d, "supplier", "s_suppkey"), "s_suppkey")
    x, y = (F.col(f"s_suppkey_{a}").cast("int").cast("string") for a in "xy")
    line = geo.st_parse(F.concat(F.lit("LINESTRING("), x, F.lit(" "), y, F.lit(", 200 100)")))
    rows = c.select("s_suppkey", F.col("s_suppkey_x").alias("x"), F.col("s_suppkey_y").alias("y"), line.alias("l"))
    return rows.select("s_suppkey", geo.st_geometry_type("l").alias("kind"), geo.st_is_empty("l").alias("empty"), geo.st_as_text(geo.st_envelope("l")).alias("box"), geo.st_equals("l", geo.st_from_wkb(geo.st_as_binary("l"))).alias("same"))


def cube_cells(spark, d):
    cell = geo.cube_cell("c_custkey_x", "c_custkey_y", 6)
    rows = _places(spark, d, "customer", "c_custkey").select("c_custkey", cell.alias("c"), geo.cube_ancestor(cell, 3).alias("up"))
    parts = geo._cube_parts(F.col("c"))
    return rows.select("c_custkey", *(p.cast("long").alias(n) for p, n in zip(parts, ("face", "level", "i", "j"))), geo._cube_parts(F.col("up"))[2].alias("up_i"), F.size(geo.cube_neighborhood(F.col("c"))).cast("long").alias("around"))


def hex_cells(spark, d):
    rows = _places(spark, d, "customer", "c_custkey").select("c_custkey", geo.hex_cell("c_custkey_x", "c_custkey_y", 10.0).alias("c"))
    x, y = geo.hex_center(F.col("c"), 10.0)
    return rows.select("c_custkey", "c.q", "c.r", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.size(geo.hex_ring(F.col("c"), 2)).cast("long").alias("around"))


def map_places(spark, d):
    x, y = geo.project("c_custkey_x", "c_custkey_y", 1000.0, 500.0)
    return _places(spark, d, "customer", "c_custkey").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def raster_forms(spark, d):
    k = F.col("s_suppkey") % 5 + 1
    box = geo.st_parse(F.concat(F.lit("POLYGON((0 0, 0 3, "), k.cast("string"), F.lit(" 3, "), k.cast("string"), F.lit(" 0, 0 0))")))
    g = load(prepare(spark), d, "supplier").select("s_suppkey", box.alias("g"))
    r = stored(g.select("s_suppkey", raster.as_raster("g", 1.0, 1.0, 2.5).alias("r")))
    back = stored(r.select("s_suppkey", raster.to_hex("r").alias("x"))).select("s_suppkey", raster.from_hex("x").alias("r"))
    return stored(back).select("s_suppkey", raster.width("r").cast("long").alias("w"), raster.height("r").cast("long").alias("h"), raster.value("r", 0, 2).alias("v"), F.length(raster.to_hex("r")).cast("long").alias("size"))


# ---------------------------------------------------------------- agents


def tool_discovery(spark, d):
    t = _vectors(spark, d).select(F.concat(F.lit("t"), F.format_string("%06d", "vec_id")).alias("name"), F.lit("tool").alias("description"), "embedding", "q")
    return agent.discover_tools(t, F.col("q"), 5).select("name", "description", (F.round("distance", 6) + 0.0).alias("distance"))


def _memory(spark, d) -> DataFrame:
    tier = F.when(F.col("event_type") == "click", "short").otherwise("episodic")
    expires = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.col("event_id") * 1000)
    return _metrics(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("agent_id"), tier.alias("tier"), "ts", F.col("event_id").alias("seq"), expires.alias("expires_at"))


def memory_short(spark, d):
    return agent.recall_short(_memory(spark, d), "7", 1_704_500_000_000).select("id")


def memory_episodic(spark, d):
    return agent.recall_episodic(_memory(spark, d), "7", 1_704_100_000_000, 1_705_500_000_000).select("id", "ts")


def memory_collected(spark, d):
    return agent.collect_garbage(_memory(spark, d), 1_704_500_000_000).groupBy("tier").agg(F.count("*").alias("n"))


def _trace(spark, d) -> DataFrame:
    return load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("evt_offset"), F.when(F.char_length("text") % 3 == 0, F.concat(F.lit("e"), F.char_length("text"))).alias("error"))


def first_errors(spark, d):
    return agent.first_error(_trace(spark, d).dropDuplicates(["session_id", "evt_offset"])).select("session_id", "evt_offset")


def audit_forged(spark, d):
    """The entries that a check of a chain finds after the third one of each session was forged."""
    c = load(spark, d, "conversations")
    log = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("turn").alias("ts"), F.col("role").alias("actor"), F.lit("say").alias("action"), F.char_length("text").cast("string").alias("details")).dropDuplicates(["session_id", "seq"])
    forged = agent.audit_chain(log).withColumn("details", F.when(F.col("seq") == 2, F.lit("forged")).otherwise(F.col("details")))
    return agent.audit_breaks(forged).select("session_id", "seq")


def provenance_history(spark, d):
    f = _metrics(spark, d).select(F.col("user_id").alias("fact_ref"), F.col("event_type").alias("source"), F.lit(1.0).alias("confidence"), F.col("event_id").alias("seq"), "ts")
    return agent.provenance_history(f, 3).select("seq", "source", "ts")


def agent_window(spark, d):
    m = _metrics(spark, d).select(F.col("user_id").cast("string").alias("agent_id"), F.col("value").alias("latency_ms"), "ts", "event_id")
    return agent.agent_metrics(m, "4", 1_704_100_000_000, 1_706_000_000_000).select("event_id", "ts", "latency_ms")


def semantic_dedupe(spark, d):
    """Memories of one direction in steps of a degree: each taken one keeps its near followers out."""
    k = F.col("c_custkey") % 90
    new = load(spark, d, "customer").groupBy((F.col("c_custkey") % 5).cast("string").alias("agent_id"), k.alias("a")).agg(F.lit(1).alias("one")).select((F.col("agent_id").cast("long") * 1000 + F.col("a")).alias("id"), "agent_id", F.array(F.cos(F.radians("a")), F.sin(F.radians("a"))).alias("embedding"))
    old = spark.createDataFrame([("semantic", "0", [1.0, 0.0])], "tier string, agent_id string, embedding array<double>")
    return agent.new_semantic(old, new, 1 - 0.99).select("id")


def related_rows(spark, d):
    facts = {t: load(prepare(spark), d, t).select(*c) for t, c in (("nation", ["n_nationkey", "n_regionkey"]), ("region", ["r_regionkey"]))}
    return graph.related(facts, [("nation", "n_regionkey", "region", "r_regionkey")], "region", "r_regionkey", 1, depth=1).select(F.col("depth").cast("long").alias("depth"), "table", "row")


QUERIES = {f.__name__: f for f in (
    copy_round_trip, csv_round_trip, json_round_trip, migrate_changed, type_map, catalog_columns, insert_defaults, alter_table, constraint_checks, json_schema_check, sequence_ids, analyze_orders,
    topic_scan, topic_poll, stream_windows, rollup_query, param_query, query_builder, user_function, tvf_graph, tvf_vector, tvf_windows, tvf_pipeline, match_text,
    json_paths, json_contains_rows, json_set_cases, json_text_search, flatten_json_all, pipeline_first_push, pipeline_literal_id,
    st_forms, st_shapes, cube_cells, hex_cells, map_places, raster_forms, tool_discovery, memory_short, memory_episodic, memory_collected, first_errors, audit_forged, provenance_history, agent_window, semantic_dedupe, related_rows,
)}

_KINDS = ("bigint", "string", "string", "double", "boolean", "smallint", "bigint", "decimal(19,4)", "decimal(38,10)", "boolean", "timestamp", "bigint", "timestamp", "double", "bigint", "int")
_MAPPED = ", ".join(f"('{s}', '{t}', '{k}')" for (s, t), k in zip(MAPPED, _KINDS))
_MEM = f"{METRICS}, y AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS agent_id, CASE WHEN event_type = 'click' THEN 'short' ELSE 'episodic' END AS tier, ts, CASE WHEN event_id % 3 <> 0 THEN ts + event_id * 1000 END AS expires_at FROM m)"
_XYZ = "(SELECT c_custkey, abs(vx) AS ax, abs(vy) AS ay, abs(vz) AS az, vx, vy, vz FROM (SELECT c_custkey, cos(radians(c_custkey_y)) * cos(radians(c_custkey_x)) AS vx, cos(radians(c_custkey_y)) * sin(radians(c_custkey_x)) AS vy, sin(radians(c_custkey_y)) AS vz FROM " + CP + "))"
_X, _Y = "CAST(CAST(c_custkey_x AS BIGINT) AS VARCHAR)", "CAST(CAST(c_custkey_y AS BIGINT) AS VARCHAR)"
_SX, _SY = "CAST(CAST(s_suppkey_x AS BIGINT) AS VARCHAR)", "CAST(CAST(s_suppkey_y AS BIGINT) AS VARCHAR)"
_HEXR = "round(2.0 / 3 * c_custkey_y / 10)"

ORACLE_SQL = {
    "copy_round_trip": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN md5(text || chr(9) || '\\t\\\\n' || chr(13) || chr(10) || '\\N') END AS digest FROM documents",
    "csv_round_trip": "SELECT c_custkey, 'a \"quoted\", ' || c_name AS name, c_acctbal FROM customer",
    "json_round_trip": "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS name, CAST(p_size AS BIGINT) AS p_size FROM part",
    "migrate_changed": "SELECT c_custkey, CASE WHEN c_custkey <= 5 THEN 'extra' ELSE 'changed' END AS problem FROM customer WHERE c_custkey <= 5 OR c_acctbal < 0",
    "type_map": f"SELECT * FROM (VALUES {_MAPPED}) v(system, name, mapped)",
    "catalog_columns": "SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS place FROM information_schema.columns WHERE table_name IN ('orders', 'nation')",
    "insert_defaults": "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'EVEN' ELSE 'NONE' END AS seg, CAST(CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 7 END AS BIGINT) AS n FROM customer WHERE c_custkey % 5 <> 0",
    "alter_table": "SELECT s_suppkey AS k, 'new' AS tag FROM supplier UNION ALL SELECT -s_suppkey - 1, 'later' FROM supplier",
    "constraint_checks": "WITH b AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey // 2 END AS k, CASE WHEN o_orderkey % 4 = 0 THEN -o_custkey ELSE o_custkey END AS c FROM orders) SELECT 'not null' AS what, count(*) AS n FROM b WHERE k IS NULL UNION ALL SELECT 'unique', count(*) FROM (SELECT k FROM b WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1) UNION ALL SELECT 'reference', count(*) FROM b WHERE c NOT IN (SELECT c_custkey FROM customer)",
    "json_schema_check": "SELECT event_id, CAST(1 + (CAST(props ->> '$.k' AS BIGINT) > 50)::INT AS BIGINT) AS broken FROM events",
    "sequence_ids": "SELECT c_custkey, CAST(98 + 2 * row_number() OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS id FROM customer",
    "analyze_orders": "SELECT 'o_custkey' AS \"column\", count(*) AS rows, count(DISTINCT o_custkey) AS \"distinct\" FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(DISTINCT o_totalprice) FROM orders",
    "topic_scan": f"WITH {METRICS}, k AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value, ts FROM m) SELECT CAST(0 AS BIGINT) AS partition, CAST(row_number() OVER (ORDER BY ts, key, value) - 1 AS BIGINT) AS \"offset\", key, value, ts AS timestamp_ms FROM k",
    "topic_poll": f"WITH {METRICS}, k AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value, ts FROM m) SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY ts, key, value) - 1 AS BIGINT) AS \"offset\", value FROM k) WHERE \"offset\" BETWEEN 10 AND 29",
    "stream_windows": f"WITH {METRICS} SELECT ts - ts % 21600000 AS window_start, ts - ts % 21600000 + 21600000 AS window_end, count(*) AS count FROM m GROUP BY 1, 2",
    "rollup_query": f"WITH {METRICS} SELECT ts - ts % {DAY} AS bucket, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM m WHERE ts - ts % {DAY} BETWEEN 1704153600000 AND 1704500000000 GROUP BY 1",
    "param_query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000",
    "query_builder": "SELECT p_partkey, p_name FROM part WHERE p_size = 7 ORDER BY p_partkey DESC LIMIT 1000",
    "user_function": "SELECT c_custkey, c_custkey * 2 - 1 AS x FROM customer",
    "tvf_graph": f"WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), one AS (SELECT DISTINCT dst AS v FROM b WHERE src = 'c1'), two AS (SELECT DISTINCT dst AS v FROM b JOIN one ON src = v WHERE dst <> 'c1' AND dst NOT IN (SELECT v FROM one)) SELECT v AS vertex, CAST(1 AS BIGINT) AS depth FROM one UNION ALL SELECT v, CAST(2 AS BIGINT) FROM two",
    "tvf_vector": "SELECT id, round(far, 6) + 0.0 AS distance FROM (SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - 1) * (CAST(v AS DOUBLE) - 1)))) AS far FROM embeddings) ORDER BY far, id LIMIT 7",
    "tvf_windows": f"WITH {METRICS}, t AS (SELECT ts - ts % {DAY} AS window_start, count(*) AS n FROM m GROUP BY 1) SELECT a.window_start, a.n, CAST(a.n + coalesce(b.n, 0) AS BIGINT) AS wide FROM t a LEFT JOIN t b ON b.window_start = a.window_start - {DAY}",
    "tvf_pipeline": "SELECT o_orderstatus AS status, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 1",
    "match_text": f"WITH {EDGES} SELECT src AS a, dst AS b FROM e WHERE src = 'c2' AND rel[1] = '2'",
    "json_paths": "SELECT o_orderkey, '\"' || o_orderstatus || '\"' AS quoted, CAST(o_orderkey AS VARCHAR) AS plain, '[\"' || o_orderkey || '\",\"' || o_orderstatus || '\"]' AS list, CAST(NULL AS VARCHAR) AS gone, CAST(NULL AS VARCHAR) AS out FROM orders",
    "json_contains_rows": "SELECT o_orderkey, o_orderkey % 4 IN (o_orderkey % 3, o_orderkey % 5) AS hit FROM orders",
    "json_set_cases": "SELECT o_orderkey, '{\"k\":' || o_orderkey || ',\"v\":[1,2]}' AS kept, '{\"k\":' || o_orderkey || ',\"v\":[1,2,3]}' AS added, '{\"k\":' || o_orderkey || ',\"v\":[9,2]}' AS changed FROM orders",
    "json_text_search": "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
    "flatten_json_all": "SELECT event_id, CAST(0 AS BIGINT) AS depth, '$' AS path, CAST(NULL AS VARCHAR) AS value, false AS is_leaf FROM events UNION ALL SELECT event_id, CAST(1 AS BIGINT), '$.k', props ->> '$.k', true FROM events",
    "pipeline_first_push": "SELECT '{\"s\":\"' || o_orderstatus || '\",\"c\":' || o_custkey || '}' AS id, max(o_orderpriority) AS top, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderpriority DESC, o_orderkey) AS keys FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' GROUP BY o_orderstatus, o_custkey",
    "pipeline_literal_id": "SELECT 'all' AS id, CAST(2 * count(*) AS DOUBLE) AS twice, min(o_totalprice) AS low FROM orders",
    "st_forms": f"SELECT c_custkey, 'SRID=4326;POINT(' || {_X} || ' ' || {_Y} || ')' AS ewkt, 'POINT ZM(' || {_X} || ' ' || {_Y} || ' ' || c_custkey || ' ' || (c_custkey + 1) || ')' AS wkt, 'POINT ZM(' || {_X} || ' ' || {_Y} || ' ' || c_custkey || ' ' || (c_custkey + 1) || ')' AS back, 'POINT M(' || {_X} || ' ' || {_Y} || ' 5)' AS measured, CAST(c_custkey AS DOUBLE) AS z, CAST(5 AS DOUBLE) AS t, CAST(4326 AS BIGINT) AS srid, CAST(3857 AS BIGINT) AS \"set\" FROM {CP}",
    "st_shapes": f"SELECT s_suppkey, 'ST_LineString' AS kind, false AS empty, 'POLYGON((' || {_SX} || ' ' || {_SY} || ', ' || {_SX} || ' 100, 200 100, 200 ' || {_SY} || ', ' || {_SX} || ' ' || {_SY} || '))' AS box, true AS same FROM {_places_sql('supplier', 's_suppkey')}",
    "cube_cells": f"WITH f AS (SELECT c_custkey, CASE WHEN ax >= ay AND ax >= az THEN CASE WHEN vx > 0 THEN 0 ELSE 3 END WHEN ay >= az THEN CASE WHEN vy > 0 THEN 1 ELSE 4 END WHEN vz > 0 THEN 2 ELSE 5 END AS face, CASE WHEN ax >= ay AND ax >= az THEN vy / ax WHEN ay >= az THEN vx / ay ELSE vx / az END AS u, CASE WHEN ax >= ay AND ax >= az THEN vz / ax WHEN ay >= az THEN vz / ay ELSE vy / az END AS w FROM {_XYZ}), g AS (SELECT c_custkey, face, CAST(least(greatest(floor((u + 1) / 2 * 64), 0), 63) AS BIGINT) AS i, CAST(least(greatest(floor((w + 1) / 2 * 64), 0), 63) AS BIGINT) AS j FROM f) SELECT c_custkey, CAST(face AS BIGINT) AS face, CAST(6 AS BIGINT) AS level, i, j, i // 8 AS up_i, CAST((CASE WHEN i IN (0, 63) THEN 2 ELSE 3 END) * (CASE WHEN j IN (0, 63) THEN 2 ELSE 3 END) AS BIGINT) AS around FROM g",
    "hex_cells": f"WITH a AS (SELECT c_custkey, (sqrt(3) / 3 * c_custkey_x - c_custkey_y / 3) / 10 AS q, (2.0 / 3 * c_custkey_y) / 10 AS r FROM {CP}), b AS (SELECT *, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM a), c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b), e AS (SELECT c_custkey, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS q, CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS r FROM c) SELECT c_custkey, CAST(q AS BIGINT) AS q, CAST(r AS BIGINT) AS r, round(10 * sqrt(3) * (q + r / 2), 6) AS x, round(15 * r, 6) AS y, CAST(19 AS BIGINT) AS around FROM e",
    "map_places": f"SELECT c_custkey, round((c_custkey_x + 180) / 360 * 1000, 6) AS x, round((90 - c_custkey_y) / 180 * 500, 6) AS y FROM {CP}",
    "raster_forms": "SELECT s_suppkey, CAST(s_suppkey % 5 + 1 AS BIGINT) AS w, CAST(3 AS BIGINT) AS h, CAST(2.5 AS DOUBLE) AS v, CAST(88 + 16 * 3 * (s_suppkey % 5 + 1) AS BIGINT) AS size FROM supplier",
    "tool_discovery": f"WITH {_V}, x AS (SELECT vec_id, 1 - list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) * sqrt(list_sum(list_transform(q, lambda v: CAST(v AS DOUBLE) * v)))) AS far FROM v) SELECT 't' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS name, 'tool' AS description, round(far, 6) + 0.0 AS distance FROM x ORDER BY far, vec_id LIMIT 5",
    "memory_short": f"WITH {_MEM} SELECT id FROM y WHERE agent_id = '7' AND tier = 'short' AND (expires_at IS NULL OR expires_at > 1704500000000)",
    "memory_episodic": f"WITH {_MEM} SELECT id, ts FROM y WHERE agent_id = '7' AND tier = 'episodic' AND ts BETWEEN 1704100000000 AND 1705500000000",
    "memory_collected": f"WITH {_MEM} SELECT tier, count(*) AS n FROM y WHERE expires_at IS NULL OR expires_at > 1704500000000 GROUP BY 1",
    "first_errors": "SELECT conv_id AS session_id, min(turn) AS evt_offset FROM conversations WHERE length(text) % 3 = 0 GROUP BY 1",
    "audit_forged": "SELECT DISTINCT conv_id AS session_id, turn AS seq FROM conversations WHERE turn = 2",
    "provenance_history": f"WITH {METRICS} SELECT event_id AS seq, event_type AS source, ts FROM m WHERE user_id = 3",
    "agent_window": f"WITH {METRICS} SELECT event_id, ts, value AS latency_ms FROM m WHERE user_id = 4 AND ts BETWEEN 1704100000000 AND 1706000000000",
    "semantic_dedupe": "WITH n AS (SELECT DISTINCT c_custkey % 5 AS g, c_custkey % 90 AS a FROM customer) SELECT CAST(g * 1000 + a AS BIGINT) AS id FROM n WHERE ((a - g) // 5) % 2 = 0 AND (g <> 0 OR a >= 10)",
    "related_rows": "SELECT CAST(0 AS BIGINT) AS depth, 'region' AS \"table\", '{\"r_regionkey\":1}' AS row UNION ALL SELECT CAST(1 AS BIGINT), 'nation', '{\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":1}' FROM nation WHERE n_regionkey = 1",
}
