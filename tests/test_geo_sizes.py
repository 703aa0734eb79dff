"""Spatial joins where one cell holds nearly all pairs, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from polyspark.operators import geo


def test_hot_cells_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(geo, "TASK_PAIRS", 500)
    rng = random.Random(7)
    places = [(k, rng.choice([10.0, 11.0, 179.9, -179.9]) + rng.random(), rng.choice([40.0, 89.5, -89.9]) + rng.random() / 10) for k in range(200)]
    a, b = spark.createDataFrame(places, "k long, x double, y double"), spark.createDataFrame(places, "m long, u double, v double")
    near = geo.dwithin_join(a, "x", "y", b, "u", "v", 30_000.0)

    def metres(p, q):
        (x1, y1), (x2, y2) = ((math.radians(v) for v in r[1:]) for r in (p, q))
        return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    want = sorted((p[0], q[0]) for p in places for q in places if metres(p, q) <= 30_000)
    assert sorted((r.k, r.m) for r in near.select("k", "m").collect()) == want
    assert "_s" in near._jdf.queryExecution().toString()
    box = lambda df, x, y, g: df.withColumn(g, geo.st_envelope(geo.st_point(x, y)))
    hit = geo.intersects_join(box(a, "x", "y", "g"), "g", box(b.where("m % 2 = 0"), "u", "v", "h"), "h", 10.0)
    assert sorted((r.k, r.m) for r in hit.select("k", "m").collect()) == [(k, k) for k in range(0, 200, 2)]
    sizes = geo.dealt_join(a.withColumn("c", F.lit(1)), b.withColumn("c", F.lit(1)), ["c"])
    assert sizes.count() == 40_000 and sizes.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000


def test_geometry_forms_by_columns(spark):
    texts = ["POINT(1 2)", "SRID=4326;POINT ZM(1 2 3 4)", "POINT M(1 2 5)", "LINESTRING(0 0, 1.5 1)", "POLYGON((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "POINT EMPTY", "CIRCLE(1)", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(1)
    g = rows.select("k", "t", geo.st_parse("t").alias("g")).select("k", "g", geo.st_as_ewkt("g").alias("e"), geo.st_as_ewkb("g").alias("b"))
    got = {r.k: r for r in g.select("*", geo.st_as_ewkt(geo.st_from_wkb("b")).alias("back")).collect()}
    for k, t in enumerate(texts):
        want = geo.parse_wkt(t)
        assert got[k].e == (want and geo.print_wkt(*want, True)) and got[k].b == (want and geo.to_wkb(*want, True).hex())
        assert got[k].back == got[k].e and got[k].g.kind == (want and want[1])
    plan = g._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
