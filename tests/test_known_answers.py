"""Small inputs with answers known beforehand."""

import math

import pytest
from pyspark.sql import functions as F

from polyspark.functions.register import create_function, register_all
from polyspark.operators import agent, document, geo, graph, raster, tables, text, timeseries, vector
from polyspark.plans.builder import Query
from polyspark.plans.sqlfront import rewrite, sql
from polyspark.sources import files
from polyspark.streaming import topics, windows


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


@pytest.fixture(scope="module")
def follows(spark):
    return spark.createDataFrame([("alice", "bob", "F"), ("bob", "carol", "F"), ("carol", "dave", "F"), ("alice", "carol", "F")], "src string, dst string, rel string")


def test_intervals():
    assert timeseries.interval_ms("1 hour") == 3_600_000
    assert timeseries.interval_ms("5 s") == 5_000
    assert timeseries.interval_ms("250 ms") == 250
    assert timeseries.interval_ms("2 months") == 2 * 30 * 86_400_000
    with pytest.raises(ValueError):
        timeseries.interval_ms("1 fortnight")


def test_time_series(spark):
    m = spark.createDataFrame([(1, 10.0), (2, None), (3, None), (4, 40.0)], "ts long, value double")
    assert values(timeseries.interpolate(m, "value", ["ts"], []), "ts", "interpolated") == [(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)]
    m = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)], "ts long, value double")
    assert values(m.select(timeseries.moving_average("value", 2, ["ts"]).alias("a")), "a") == [10.0, 15.0, 25.0, 35.0]
    assert values(spark.range(1).select(timeseries.time_bucket("1 hour", F.lit(5_400_000)).alias("b"), timeseries.time_bucket("1 hour", F.lit(-1)).alias("c")), "b", "c") == [(3_600_000, -3_600_000)]
    r = spark.createDataFrame([(0, 5.0), (36_000_000, 50.0)], "ts long, value double")
    assert values(timeseries.retained(r, "ts", "2 hours"), "ts") == [36_000_000]
    assert values(timeseries.rollup_query(r, "1 hour", "ts", "value", 0, 0), "bucket", "count") == [(0, 1)]


def test_windows(spark):
    log = spark.createDataFrame([(0,), (5,), (9,), (30,), (31,)], "timestamp_ms long")
    assert values(windows.tumbling(log, 10), "window_start", "count") == [(0, 3), (30, 2)]
    assert sum(values(windows.session(log, 1000), "count")) == 5
    assert values(windows.session(log, 5), "window_start", "window_end", "count") == [(0, 9, 3), (30, 31, 2)]
    assert values(windows.session(log, 0), "count") == [1] * 5
    assert values(windows.sliding(log, 3, 10), "window_start", "count") == [(7, 1)]


def test_topic(spark, tmp_path):
    t = topics.Topic(spark, f"file://{tmp_path}", "news", partitions=2)
    assert t.read().count() == 0
    t.publish(spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "key string, value string"))
    t.publish(spark.createDataFrame([("a", "4")], "key string, value string"))
    assert t.read().groupBy("partition").agg(F.countDistinct("offset").alias("n"), F.max("offset").alias("m")).where("n <> m + 1").count() == 0
    part = t.read().where("key = 'a'").first()["partition"]
    assert [r.offset for r in t.poll("g", part, 1).collect()] == [0]
    t.commit("g", part, 1)
    t = topics.Topic(spark, f"file://{tmp_path}", "news", partitions=2)  # offsets outlive the object
    assert [r.offset for r in t.poll("g", part, 1).collect()] == [1]


def test_time_travel(spark):
    log = spark.createDataFrame([("1", "insert", "widget", 10, 0), ("1", "update", "gadget", 20, 1), ("1", "delete", None, 30, 2)], "row_key string, op string, after string, ts long, offset long")
    assert values(topics.time_travel(log, 10), "data") == ["widget"]
    assert values(topics.time_travel(log, 25), "data") == ["gadget"]
    assert values(topics.time_travel(log, 30), "data") == []


def test_streams(spark, tmp_path):
    t = topics.Topic(spark, f"file://{tmp_path}", "live")
    t.publish(spark.createDataFrame([("a", "x", 1_000), ("a", "y", 4_000), ("b", "z", 61_000)], "key string, value string, timestamp_ms long"))
    live = windows.stream_tumbling(topics.read_stream(spark, t.path), "10 seconds", "1 minute")
    q = live.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("counts"), "count") == [1, 2]


def test_graph(spark, follows):
    assert values(graph.neighbors(follows, "alice"), "neighbor") == ["bob", "carol"]
    assert values(graph.neighbors(follows, "carol", "both"), "neighbor") == ["alice", "bob", "dave"]
    assert values(graph.bfs(follows, "alice"), "vertex", "depth") == [("alice", 0), ("bob", 1), ("carol", 1), ("dave", 2)]
    assert [r.vertex for r in graph.shortest_path(follows, "alice", "dave").orderBy("step").collect()] == ["alice", "carol", "dave"]
    assert graph.shortest_path(follows, "alice", "nobody").count() == 0
    two = follows.union(spark.createDataFrame([("xavier", "yolanda", "F")], follows.schema))
    assert len({c for _, c in values(graph.connected_components(two), "vertex", "component")}) == 2
    rank = dict(values(graph.pagerank(follows), "vertex", "score"))
    assert rank["dave"] > rank["alice"] and abs(sum(rank.values()) - 1) < 1e-9
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert values(graph.triangle_count(ring), "triangles") == [1, 1, 1]
    follows.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "rel").createOrReplaceTempView("follows")
    assert values(sql(spark, "MATCH (a)-[:F]->(b) ON follows(from_id) WHERE a = 'alice' RETURN a, b"), "a", "b") == [("alice", "bob"), ("alice", "carol")]


def test_vectors(spark):
    one = spark.range(1)
    got = one.select(vector.l2_distance([0, 0], [3, 4]).alias("l"), vector.dot_product([1, 2, 3], [4, 5, 6]).alias("d"), vector.cosine_similarity([1, 0], [0, 1]).alias("o"), vector.cosine_similarity([1, 0], [-2, 0]).alias("n")).first()
    assert tuple(got) == (5.0, 32.0, 0.0, -1.0)
    with pytest.raises(Exception):
        one.select(vector.l2_distance([1], [1, 2])).collect()
    docs = spark.createDataFrame(
        [(1, "rust systems programming rust rust", [1.0, 0.0, 0.0]), (2, "python scripting language", [0.95, 0.05, 0.0]), (3, "rust programming language", [-1.0, -1.0, -1.0]), (4, "cooking recipes and food", [-0.9, -0.9, -1.0])],
        "id int, body string, e array<double>",
    )
    assert [r.id for r in vector.vector_search(docs, "e", [1, 0, 0], "id", 2).collect()] == [1, 2]
    found = [r.id for r in vector.hybrid_search(docs, "id", "e", [1, 0, 0], "body", "rust", 3).collect()]
    assert found[0] == 1 and set(found) == {1, 2, 3}
    assert [r.id for r in text.bm25_topk(docs, "id", "body", "rust").collect()] == [1, 3]
    model, cells = vector.kmeans_cells(docs, "e", k=2)
    assert vector.probe_search(cells, model, "e", [1, 0, 0], "id", 1, probes=2).first().id == 1


def test_text_search(spark):
    docs = spark.createDataFrame([(1, '{"tags":["admin","beta"]}'), (2, '{"tags":["user"]}'), (3, '{"tags":["user","beta"]}')], "id int, body string")
    assert values(text.text_search(docs, "id", "body", "beta", is_json=True), "id") == [1, 3]
    assert text.text_search(docs, "id", "body", "  ").count() == 0


def test_json(spark):
    d = spark.createDataFrame([('{"a":{"b":[1,"x"]},"n":null}',)], "j string")
    got = d.select(document.extract("j", "a", "b", 1).alias("q"), document.extract_text("j", "a", "b", 1).alias("t"), document.arrow("j", "n").alias("n"), document.json_typeof(document.arrow("j", "a")).alias("k")).first()
    assert tuple(got) == ('"x"', "x", None, "object")
    assert d.select(document.json_set("j", ["a", "b", "9"], 5).alias("x")).first().x == '{"a":{"b":[1,"x",5]},"n":null}'
    assert d.select(document.json_contains("j", F.lit('{"a":{"b":["x"]}}')).alias("x")).first().x
    assert not d.select(document.json_contains("j", F.lit('{"a":{"b":[1.0]}}')).alias("x")).first().x
    schema = {"type": "object", "required": ["a", "z"], "properties": {"n": {"type": "string"}}}
    assert len(d.select(document.validate_json("j", schema).alias("v")).first().v) == 2
    assert d.select(document.validate_json("j", schema, "relaxed").alias("v")).first().v == []
    assert values(document.flatten_json(d.withColumn("id", F.lit(1)), "id", "j").where("is_leaf"), "path") == ["$.a.b[0]", "$.a.b[1]", "$.n"]


def test_pipeline(spark):
    docs = spark.createDataFrame([("eng", "a", 100), ("eng", "b", 200), ("sales", "c", 50), ("sales", "d", 150)], "dept string, name string, amount int")
    got = document.run_pipeline(docs, '[{"$group":{"_id":"$dept","s":{"$sum":"$amount"},"n":{"$count":{}},"m":{"$avg":"$amount"},"all":{"$push":"$name"}}}]', ["name"])
    assert [tuple(r) for r in got.where("_id = 'eng'").collect()] == [("eng", 300.0, 2.0, 150.0, ["a", "b"])]
    assert [r.name for r in document.run_pipeline(docs, [{"$sort": {"amount": -1}}, {"$skip": 1}, {"$limit": 2}]).collect()] == ["d", "a"]
    assert document.run_pipeline(docs, [{"$match": {"amount": {"$in": [50, 100]}, "dept": {"$ne": "eng"}}}]).count() == 1
    top = document.run_pipeline(docs, [{"$sort": {"name": -1}}, {"$group": {"_id": "$dept", "f": {"$first": "$name"}, "all": {"$push": "$name"}}}])
    assert values(top, "_id", "f", "all") == [("eng", "b", ["b", "a"]), ("sales", "d", ["d", "c"])]
    with pytest.raises(ValueError):
        document.run_pipeline(docs, [{"$what": 1}])


def test_geometry(spark):
    d = spark.createDataFrame([("POLYGON((0 0, 0 10, 10 10, 10 0, 0 0))", "SRID=4326;POINT(5 5)", "LINESTRING(0 0, 1 0)")], "p string, q string, l string")
    g = d.select(geo.st_parse("p").alias("p"), geo.st_parse("q").alias("q"), geo.st_parse("l").alias("l"))
    got = g.select(
        geo.st_contains("p", "q").alias("in"), geo.st_area("p").alias("area"), geo.st_srid("q").alias("srid"), geo.st_as_ewkt("q").alias("ewkt"), geo.st_geometry_type("l").alias("kind"),
        geo.st_dimension("p").alias("dim"), geo.st_is_empty("p").alias("empty"), geo.st_intersects("p", "l").alias("hit"), geo.st_as_text(geo.st_envelope("l")).alias("box"), F.round(geo.st_length("l")).alias("len"),
    ).first()
    assert tuple(got) == (True, 100.0, 4326, "SRID=4326;POINT(5 5)", "ST_LineString", 2, False, True, "POLYGON((0 0, 0 0, 1 0, 1 0, 0 0))", 111195.0)
    back = g.select(geo.st_as_text(geo.st_from_wkb(geo.st_as_ewkb("p"))).alias("p"), geo.st_equals("q", geo.st_from_wkb(geo.st_as_binary("q"))).alias("same")).first()
    assert tuple(back) == ("POLYGON((0 0, 0 10, 10 10, 10 0, 0 0))", True)
    trip = g.select(geo.st_transform(geo.st_transform("q", 3857), 4326).alias("r")).select(geo.st_x("r").alias("x"), geo.st_y("r").alias("y")).first()
    assert math.isclose(trip.x, 5) and math.isclose(trip.y, 5)
    forms = ["POINT Z(1 2 3)", "POINT M(1 2 3)", "POINT ZM(1 2 3 4)", "LINESTRING M(0 0 5, 1 1 6)"]
    w = spark.createDataFrame([(f,) for f in forms], "w string").select("w", geo.st_parse("w").alias("g"))
    assert all(r.w == r.t == r.b for r in w.select("w", geo.st_as_text("g").alias("t"), geo.st_as_text(geo.st_from_wkb(geo.st_as_ewkb("g"))).alias("b")).collect())
    assert g.select(geo.st_contains(geo.st_literal("POLYGON((0 0, 0 10, 10 10, 10 0, 0 0))"), "q").alias("x")).first().x
    assert geo.parse_wkt("CIRCLE(0 0)") is None and geo.parse_wkt("POINT EMPTY") == (0, "POINT", [])
    r = g.select(raster.as_raster("p", 2.0, 5.0).alias("r"))
    assert tuple(r.select(raster.width("r"), raster.height("r"), raster.value("r", 0, 0), raster.value("r", 9, 9)).first()) == (5, 2, 1.0, None)
    back = r.select(raster.from_hex(raster.to_hex("r")).alias("s"), "r").first()
    assert back.s == back.r


def test_dwithin_join_is_exact(spark):
    import random

    rng = random.Random(4)
    pts = [(i, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90)])) for i in range(150)] + [(900, 179.99, 10.0), (901, -179.99, 10.0), (902, 0.0, 90.0), (903, 120.0, 89.9)]
    a = spark.createDataFrame(pts, "i int, x double, y double")
    b = a.select(F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    near = values(geo.dwithin_join(a, "x", "y", b, "u", "v", 900_000.0), "i", "j")
    every = values(a.crossJoin(b).where(geo.haversine("x", "y", "u", "v") <= 900_000.0), "i", "j")
    assert near == every and (900, 901) in near and (902, 903) in near


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, s int")
    assert values(tables.upsert(t, ["k"], "s").where("k = 1"), "v") == ["b"]
    assert values(tables.unique_violations(t, ["k"]), "k", "n") == [(1, 2)]
    assert tables.unique_violations(t, ["v"]).count() == 0
    assert values(tables.fk_violations(t, "v", spark.createDataFrame([("a",)], "v string"), "v"), "v") == ["b"]
    assert tables.not_null_violations(t, ["v"]).count() == 1
    assert values(tables.delete_where(tables.update_where(t, "k = 1", v="upper(v)"), "v = 'A'").na.fill("-"), "v") == ["-", "B"]
    s = tables.Sequence(10)
    assert (s.nextval(), s.nextval(), s.currval(), s.setval(20), s.nextval()) == (10, 11, 11, 20, 21)
    assert values(s.assign(t, "id", "k", "s"), "id") == [22, 23, 24] and s.currval() == 24


def test_agent(spark):
    log = spark.createDataFrame([("s", i, i, "me", "do", f"d{i}") for i in range(4)], "session_id string, seq long, ts long, actor string, action string, details string")
    chain = agent.audit_chain(log)
    assert chain.count() == 4 and agent.audit_breaks(chain).count() == 0
    assert values(agent.audit_breaks(chain.withColumn("details", F.when(F.col("seq") == 2, "forged").otherwise(F.col("details")))), "seq") == [2]
    m = spark.createDataFrame([("1", "a", "semantic", [1.0, 0.0], "x"), ("2", "b", "semantic", [1.0, 0.0], "y")], "id string, agent_id string, tier string, embedding array<double>, content string")
    assert values(agent.recall_semantic(m, "a", [1, 0], 5), "content") == ["x"]
    new = spark.createDataFrame([("3", "a", [1.0, 0.001]), ("4", "a", [0.0, 1.0])], "id string, agent_id string, embedding array<double>")
    assert values(agent.new_semantic(m, new), "id") == ["4"]
    chain = spark.createDataFrame([(str(k), "a", [math.cos(k / 10), math.sin(k / 10)]) for k in range(5, 10)] + [("55", "a", [math.cos(0.5), math.sin(0.5)])], new.schema)
    assert values(agent.new_semantic(m, chain, 0.006), "id") == ["5", "7", "9"]  # a taken one keeps its neighbours out, these no further ones
    assert values(agent.provenance_history(spark.createDataFrame([("f", 2), ("f", 1), ("g", 1)], "fact_ref string, seq long"), "f"), "seq") == [1, 2]


def test_files(spark, tmp_path):
    t = spark.createDataFrame([(1, "a\tb\\c\nd"), (2, None), (3, "")], "id int, v string")
    files.write_copy(t, f"{tmp_path}/copy")
    assert sorted(map(tuple, files.read_copy(spark, f"{tmp_path}/copy", "id int, v string").collect())) == sorted(map(tuple, t.collect()))
    files.write_csv(t.na.fill("-"), f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", t.schema).count() == 3
    files.write_json(t, f"{tmp_path}/json")
    assert files.read_json(spark, f"{tmp_path}/json", t.schema).where("v is null").count() == 1
    assert files.read_json(spark, f"{tmp_path}/json", t.schema).count() == 3
    (tmp_path / "array.json").write_text('\n [{"id": 1, "v": "a"},\n {"id": 2, "v": null}]')
    assert files.read_json(spark, f"{tmp_path}/array.json", t.schema).count() == 2
    assert (files.map_type("mysql", "TINYINT(1)"), files.map_type("mysql", "tinyint(4)"), files.map_type("odbc", -7)) == ("boolean", "smallint", "boolean")
    assert files.migrate(t, f"{tmp_path}/moved", ["id"]).count() == 0
    assert "| 1 " in files.as_text_table(t.na.fill("-"))
    assert files.map_type("postgres", "NUMERIC(10,2)") == "decimal(38,10)" and files.map_type("mysql", "geometry") == "string"
    t.createOrReplaceTempView("listed")
    assert files.information_schema_columns(spark).where("table_name = 'listed'").count() == 2


def test_sql_front(spark):
    spark.createDataFrame([(1, '{"a":{"b":[7,"x"]},"k":"v"}')], "id int, j string").createOrReplaceTempView("docs_j")
    got = sql(spark, "SELECT j -> 'a' -> 'b' AS o, j ->> 'k' AS t, j #>> '{a,b,1}' AS p, j ~ 'x' AS m, j !~* 'QQ' AS n FROM docs_j WHERE id = $1", [1]).first()
    assert tuple(got) == ('[7,"x"]', "v", "x", True, True)
    assert rewrite("SELECT 'a -> b' FROM t -- x -> y") == "SELECT 'a -> b' FROM t -- x -> y"
    got = sql(spark, "SELECT row_key FROM json_path_lookup('docs_j', 'j', 'k', $1) WHERE row_key > $2", ["v", 0]).collect()
    assert [r.row_key for r in got] == [1]
    q = Query("docs_j").select("id").filter_eq("id", 1).order_by("id", False).limit(5).offset(0)
    assert q.build() == ("SELECT id FROM docs_j WHERE id = ? ORDER BY id DESC LIMIT 5 OFFSET 0", [1])
    assert q.run(spark).count() == q.apply(spark.table("docs_j")).count() == 1


def test_functions(spark):
    register_all(spark)
    got = spark.sql("SELECT time_bucket('1 hour', 5400000L) AS b, l2_distance(array(0D, 0D), array(3D, 4D)) AS l, cosine_similarity(array(1D, 0D), array(0D, 1D)) AS c, json_contains('[1,2]', '[2]') AS j").first()
    assert tuple(got) == (3_600_000, 5.0, 0.0, True)
    create_function(spark, "twice", "int8", lambda s: s * 2)
    assert spark.sql("SELECT twice(21L) AS x").first().x == 42


def test_declared_tables(spark, tmp_path):
    from polyspark.operators.ddl import ConstraintError, Table
    from polyspark.sources import catalogs

    root = f"file://{tmp_path}"
    feed = topics.Topic(spark, root, "cdc")
    parent = Table(spark, root, "parent", "id int, name string", primary_key=["id"])
    child = Table(spark, root, "child", "id int, p int, j string", primary_key=["id"], defaults={"j": "{}"}, json_schemas={"j": ({"type": "object"}, "strict")}, cdc=feed).references("p", parent, "id")
    parent.insert(spark.createDataFrame([(1, "a"), (2, "b")], parent.schema))
    child.insert(spark.createDataFrame([(10, 1), (11, None)], "id int, p int"))
    for bad in ([(10, 1, "{}")], [(12, 9, "{}")], [(None, 1, "{}")], [(13, 1, "[]")]):
        with pytest.raises(ConstraintError):
            child.insert(spark.createDataFrame(bad, child.schema))
    child.update("id = 11", p="2")
    child.upsert(spark.createDataFrame([(10, 2, "{}"), (14, 1, "{}")], child.schema))
    child.delete("id = 14")
    assert values(child.read(), "id", "p", "j") == [(10, 2, "{}"), (11, 2, "{}")]
    ops = feed.read().select(F.get_json_object("value", "$.op").alias("op")).groupBy("op").count()
    assert dict(values(ops, "op", "count")) == {"insert": 3, "update": 2, "delete": 1}
    child.add_column("extra", "int", 7)
    child.create_index("by_p", "p", method="graph", to="id")
    assert values(child.read(), "extra") == [7, 7]
    child.drop_column("extra")
    assert child.read().columns == ["id", "p", "j"]
    assert values(catalogs.pg_constraint(spark, [parent, child]).where("contype = 'f'"), "confrelname") == ["parent"]
    assert "pg_type" in catalogs.register_views(spark, [child]) and spark.sql("SELECT indexdef FROM pg_indexes").first()[0] == "graph (p)"


def test_describe(spark):
    from polyspark.plans import describe

    spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string").createOrReplaceTempView("seen")
    assert "seen" in describe.list_tables(spark) and describe.list_columns(spark, "seen")[1] == ("v", "string")
    assert describe.schema(spark, "seen")["v"]["top"] == [("a", 2)]
    assert describe.query(spark, "SELECT count(*) AS n FROM seen") == [{"n": 2}]
    assert "Scan" in describe.explain(spark.table("seen").where("id = 1")) or "LocalTableScan" in describe.explain(spark.table("seen"))
    with pytest.raises(ValueError):
        describe.query(spark, "DROP TABLE seen")
    register_all(spark)
    assert sql(spark, """SELECT '{"a":1}' @> '{"a":1}' AS y""").first().y


def test_cube_cells(spark):
    pts = spark.createDataFrame([(float(x), float(y)) for x in range(-180, 180, 17) for y in range(-90, 91, 15)], "x double, y double")
    c = pts.select(geo.cube_cell("x", "y", 8).alias("fine"), geo.cube_cell("x", "y", 5).alias("coarse"))
    assert c.where(geo.cube_ancestor(F.col("fine"), 5) != F.col("coarse")).count() == 0
    assert c.where(~F.array_contains(geo.cube_neighborhood(F.col("fine")), F.col("fine"))).count() == 0
    assert values(c.select(F.size(geo.cube_neighborhood(F.col("fine"))).alias("n")).distinct(), "n")[-1] == 9
    assert geo.cube_level_for_radius(1000) > geo.cube_level_for_radius(100_000)


def test_subscribe(spark, tmp_path):
    t = topics.Topic(spark, f"file://{tmp_path}", "pushed")
    t.publish(spark.createDataFrame([("a", "1")], "key string, value string"))
    got = []
    q = topics.subscribe(topics.read_stream(spark, t.path), lambda df, i: got.extend(r.value for r in df.collect()), f"file://{tmp_path}/ck", available_now=True)
    q.awaitTermination()
    assert got == ["1"]
