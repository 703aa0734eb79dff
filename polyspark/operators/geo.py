"""Geometry as WKT text at the edges and one parsed struct inside: (srid, kind, rings of points).

Points and measures are column expressions; parsing and printing of lines, polygons and binary forms are Arrow UDFs, one
call for a batch. A spatial join deals both sides to grid cells, joins on the cell and then tests exactly.
"""

from __future__ import annotations

import math
import re
import struct

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

EARTH_M = 6_371_008.8
MERCATOR_M = 6_378_137.0
MERCATOR_LAT = 85.05112878

POINT = "struct<x:double,y:double,z:double,t:double>"
GEOMETRY = f"struct<srid:int,kind:string,rings:array<array<{POINT}>>>"
KINDS = ("POINT", "LINESTRING", "POLYGON")


# ---------------------------------------------------------------- text and binary forms


def parse_wkt(text: str):
    """(srid, kind, rings) of (E)WKT; None for what is not a point, line or polygon."""
    m = re.fullmatch(r"\s*(?:SRID=(\d+);)?\s*(POINT|LINESTRING|POLYGON)\s*(ZM|Z|M)?\s*(EMPTY|\(.*\))\s*", text or "", re.I | re.S)
    if not m:
        return None
    srid, kind = int(m[1] or 0), m[2].upper()
    if m[4].upper() == "EMPTY":
        return srid, kind, []
    body = m[4][1:-1]
    measured = (m[3] or "").upper() == "M"
    parts = re.findall(r"\(([^()]*)\)", body) if kind == "POLYGON" else [body]
    try:
        rings = [[tuple(float(v) for v in p.split()) for p in part.split(",")] for part in parts]
    except ValueError:
        return None
    if not rings or any(not 2 <= len(p) <= 4 for r in rings for p in r):
        return None
    full = lambda p: (*p[:2], None, p[2]) if measured and len(p) == 3 else p + (None,) * (4 - len(p))
    return srid, kind, [[full(p) for p in r] for r in rings]


def _number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def print_wkt(srid: int, kind: str, rings, with_srid: bool = False) -> str:
    head = f"SRID={srid};" if with_srid and srid else ""
    if not rings:
        return f"{head}{kind} EMPTY"
    point = lambda p: " ".join(_number(v) for v in p if v is not None)
    tag = "".join(t for t, k in (("Z", 2), ("M", 3)) if any(p[k] is not None for r in rings for p in r))
    kind = f"{kind} {tag}" if tag else kind
    parts = [", ".join(point(p) for p in r) for r in rings]
    return f"{head}{kind}(" + (", ".join(f"({p})" for p in parts) if kind.startswith("POLYGON") else parts[0]) + ")"


def to_wkb(srid: int, kind: str, rings, with_srid: bool = False) -> bytes:
    """Little-endian (E)WKB with Z and M flags from the first point."""
    first = rings[0][0] if rings else (0, 0, None, None)
    dims = 2 + (first[2] is not None) + (first[3] is not None)
    code = KINDS.index(kind) + 1 | (0x80000000 if first[2] is not None else 0) | (0x40000000 if first[3] is not None else 0) | (0x20000000 if with_srid and srid else 0)
    out = struct.pack("<BI", 1, code) + (struct.pack("<I", srid) if with_srid and srid else b"")
    points = lambda r: b"".join(struct.pack(f"<{dims}d", *[v for v in p if v is not None]) for p in r)
    if kind == "POINT":
        return out + (points(rings[0]) if rings else struct.pack("<2d", math.nan, math.nan))
    if kind == "LINESTRING":
        return out + struct.pack("<I", len(rings[0]) if rings else 0) + (points(rings[0]) if rings else b"")
    return out + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + points(r) for r in rings)


def from_wkb(raw: bytes):
    """(srid, kind, rings) of (E)WKB in either byte order; None for other kinds or broken bytes."""
    try:
        e = "<" if raw[0] == 1 else ">"
        code, = struct.unpack_from(e + "I", raw, 1)
        at, srid = 5, 0
        if code & 0x20000000:
            srid, = struct.unpack_from(e + "I", raw, at)
            at += 4
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        kind, dims = KINDS[(code & 0xFF) - 1], 2 + z + m

        def take(n):
            nonlocal at
            ring = []
            for _ in range(n):
                v = struct.unpack_from(f"{e}{dims}d", raw, at)
                at += 8 * dims
                ring.append((v[0], v[1], v[2] if z else None, v[2 + z] if m else None))
            return ring

        def count():
            nonlocal at
            at += 4
            return struct.unpack_from(e + "I", raw, at - 4)[0]

        if kind == "POINT":
            p = take(1)
            return srid, kind, [] if math.isnan(p[0][0]) else [p]
        if kind == "LINESTRING":
            n = count()
            return srid, kind, [take(n)] if n else []
        return srid, kind, [take(count()) for _ in range(count())]
    except (struct.error, IndexError):
        return None


ARROW_POINT = pa.struct([(c, pa.float64()) for c in "xyzt"])


def _to_arrow(rows: list) -> pa.Array:
    """Geometries (srid, kind, rings) as one struct array, by columns; None gives null fields."""
    rings_at, points_at, points = [0], [0], []
    for g in rows:
        for r in g[2] if g else ():
            points += r
            points_at.append(len(points))
        rings_at.append(len(points_at) - 1)
    axes = list(zip(*points)) if points else [[]] * 4
    flat = pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in axes], fields=list(ARROW_POINT))
    inner = pa.ListArray.from_arrays(pa.array(points_at, pa.int32()), flat)
    outer = pa.ListArray.from_arrays(pa.array(rings_at, pa.int32()), inner, mask=pa.array([g is None for g in rows]))
    return pa.StructArray.from_arrays([pa.array([g and g[0] for g in rows], pa.int32()), pa.array([g and g[1] for g in rows], pa.string()), outer], ["srid", "kind", "rings"])


def _from_arrow(column: pa.Array) -> list:
    """(srid, kind, rings) of each row, None where the geometry or its kind is null."""
    srid, kind, outer = (pa.compute.struct_field(column, [k]) for k in range(3))
    inner = outer.values
    points = inner.values
    at, ring_at = (c.offsets.to_pylist() for c in (outer, inner))
    flat = list(zip(*(points.field(c).to_pylist() for c in "xyzt")))
    rows = zip(srid.to_pylist(), kind.to_pylist(), outer.is_null().to_pylist(), at, at[1:])
    return [None if k is None or gone else (s, k, [flat[ring_at[i] : ring_at[i + 1]] for i in range(lo, hi)]) for s, k, gone, lo, hi in rows]


def _parsed(text: pa.Array) -> pa.Array:
    return _to_arrow([parse_wkt(t) for t in text.to_pylist()])


def st_parse(text) -> Column:
    """The parsed geometry of (E)WKT; its fields are null for what is no point, line or polygon."""
    return F.arrow_udf(_parsed, GEOMETRY)(_c(text))


def st_literal(text: str) -> Column:
    """A constant geometry: parsed once, here, and part of the plan as a value."""
    g = parse_wkt(text)
    if g is None:
        raise ValueError(f"not a geometry: {text!r}")
    number = lambda v, n: F.lit(v).cast("double").alias(n)
    point = lambda p: F.struct(*(number(v, n) for v, n in zip(p, "xyzt")))
    rings = F.array(*(F.array(*(point(p) for p in r)) for r in g[2])) if g[2] else F.expr(f"cast(array() as array<array<{POINT}>>)")
    return F.struct(F.lit(g[0]).alias("srid"), F.lit(g[1]).alias("kind"), rings.alias("rings"))


def st_from_wkb(hexed) -> Column:
    """The parsed geometry of (E)WKB in hex text."""
    def run(column: pa.Array) -> pa.Array:
        rows = [from_wkb(bytes.fromhex(h)) if h else None for h in column.to_pylist()]
        out = _to_arrow(rows)
        return pa.StructArray.from_arrays([out.field(k) for k in range(3)], fields=list(out.type), mask=pa.array([g is None for g in rows]))

    return F.arrow_udf(run, GEOMETRY)(_c(hexed))


def _printer(f):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if g is None else f(*g) for g in _from_arrow(column)], pa.string())

    return lambda g: F.arrow_udf(run, "string")(_c(g))


st_as_text = _printer(lambda s, k, r: print_wkt(s, k, r))
st_as_ewkt = _printer(lambda s, k, r: print_wkt(s, k, r, True))
st_as_binary = _printer(lambda s, k, r: to_wkb(s, k, r).hex())
st_as_ewkb = _printer(lambda s, k, r: to_wkb(s, k, r, True).hex())


# ---------------------------------------------------------------- measures on parsed geometry


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def st_point(x, y, z=None, t=None, srid: int = 0) -> Column:
    p = F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), _c(z).cast("double").alias("z"), _c(t).cast("double").alias("t"))
    return F.struct(F.lit(srid).alias("srid"), F.lit("POINT").alias("kind"), F.array(F.array(p)).alias("rings"))


def st_set_srid(g, srid: int) -> Column:
    return _c(g).withField("srid", F.lit(srid))


def st_srid(g) -> Column:
    return F.coalesce(_c(g)["srid"], F.lit(0))


def _outer(g) -> Column:
    return F.get(_c(g)["rings"], F.lit(0))


def _mean(g, axis: str) -> Column:
    """Of the representative point: a point itself, a line's first vertex, the mean of all listed vertices of a polygon's outer ring."""
    ring = _outer(g)
    total = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(ring)
    return F.when(_c(g)["kind"] == "POLYGON", total).otherwise(F.get(ring, F.lit(0))[axis])


def st_x(g) -> Column:
    return _mean(g, "x")


def st_y(g) -> Column:
    return _mean(g, "y")


def st_z(g) -> Column:
    return F.get(_outer(g), F.lit(0))["z"]


def st_t(g) -> Column:
    return F.get(_outer(g), F.lit(0))["t"]


def haversine(x1, y1, x2, y2) -> Column:
    """Metres between two places in degrees."""
    x1, y1, x2, y2 = (F.radians(_c(v)) for v in (x1, y1, x2, y2))
    h = F.pow(F.sin((y2 - y1) / 2), 2) + F.cos(y1) * F.cos(y2) * F.pow(F.sin((x2 - x1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def st_distance(a, b) -> Column:
    return haversine(st_x(a), st_y(a), st_x(b), st_y(b))


def st_dwithin(a, b, metres) -> Column:
    return st_distance(a, b) <= _c(metres)


def _edges(ring: Column) -> Column:
    """Consecutive pairs of a ring's points."""
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("p"), F.get(ring, i).alias("q")))


def st_contains(polygon, g) -> Column:
    """Whether the representative point lies in the outer ring (ray casting); null for what is not a polygon."""
    x, y, ring = st_x(g), st_y(g), _outer(polygon)
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1)).alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    inside = F.size(F.filter(pairs, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return F.when(_c(polygon)["kind"] == "POLYGON", inside)


def st_within(g, polygon) -> Column:
    return st_contains(polygon, g)


def bbox(g) -> Column:
    points = F.flatten(_c(g)["rings"])
    axis = lambda f, a: f(F.transform(points, lambda p: p[a]))
    return F.struct(axis(F.array_min, "x").alias("x0"), axis(F.array_min, "y").alias("y0"), axis(F.array_max, "x").alias("x1"), axis(F.array_max, "y").alias("y1"))


def bbox_overlap(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def st_intersects(a, b) -> Column:
    """Overlap of the bounding boxes."""
    return bbox_overlap(bbox(a), bbox(b))


def st_length(g) -> Column:
    ring = _outer(g)
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + haversine(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))
    return F.when(_c(g)["kind"] != "LINESTRING", 0.0).when(F.size(ring) < 2, 0.0).otherwise(total)


def st_area(g) -> Column:
    """Planar area of the outer ring in squared units."""
    ring = _outer(g)
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.when(_c(g)["kind"] != "POLYGON", 0.0).when(F.size(ring) < 3, 0.0).otherwise(F.abs(total) / 2)


def st_geometry_type(g) -> Column:
    return F.concat(F.lit("ST_"), F.when(_c(g)["kind"] == "LINESTRING", "LineString").otherwise(F.initcap(_c(g)["kind"])))


def st_dimension(g) -> Column:
    return F.when(_c(g)["kind"] == "POINT", 0).when(_c(g)["kind"] == "LINESTRING", 1).when(_c(g)["kind"] == "POLYGON", 2)


def st_is_empty(g) -> Column:
    return F.size(F.flatten(_c(g)["rings"])) == 0


def st_equals(a, b) -> Column:
    return (_c(a)["kind"] == _c(b)["kind"]) & (_c(a)["rings"] == _c(b)["rings"])


def st_envelope(g) -> Column:
    """The bounding box as a polygon."""
    b = bbox(g)
    corner = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("t"))
    ring = F.array(corner("x0", "y0"), corner("x0", "y1"), corner("x1", "y1"), corner("x1", "y0"), corner("x0", "y0"))
    return F.struct(_c(g)["srid"].alias("srid"), F.lit("POLYGON").alias("kind"), F.array(ring).alias("rings"))


def st_transform(g, srid: int) -> Column:
    """Between 4326 and 3857."""
    g = _c(g)

    def forward(p: Column) -> Column:
        lat = F.radians(F.greatest(F.least(p["y"], F.lit(MERCATOR_LAT)), F.lit(-MERCATOR_LAT)))
        return p.withField("x", F.radians(p["x"]) * MERCATOR_M).withField("y", F.log(F.tan(math.pi / 4 + lat / 2)) * MERCATOR_M)

    def back(p: Column) -> Column:
        return p.withField("x", F.degrees(p["x"] / MERCATOR_M)).withField("y", F.degrees(2 * F.atan(F.exp(p["y"] / MERCATOR_M)) - math.pi / 2))

    step = {3857: forward, 4326: back}.get(srid)
    if step is None:
        return F.raise_error(F.lit(f"unknown SRID {srid}"))
    moved = F.transform(g["rings"], lambda r: F.transform(r, step))
    other = F.when(st_srid(g).isin(3857, 4326), g.withField("rings", moved).withField("srid", F.lit(srid)))
    return F.when(st_srid(g) == srid, g).otherwise(other)


# ---------------------------------------------------------------- joins and grids


def cells_of(box: Column, size: float) -> Column:
    """The grid cells that a bounding box touches."""
    lo = lambda v: F.floor(v / size).cast("long")
    xs, ys = F.sequence(lo(box["x0"]), lo(box["x1"])), F.sequence(lo(box["y0"]), lo(box["y1"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("i"), y.alias("j")))))


#: Pairs of rows of one cell that a task compares, about, and the most tasks.
TASK_PAIRS, MOST_TASKS = 20_000_000, 4096


def dealt_join(left: DataFrame, right: DataFrame, cell: list[str]) -> DataFrame:
    """``left`` and ``right`` joined on their cells, dealt by pairs rather than bytes: a cell of many pairs is cut into pieces, each with a
    share of its left rows and all its right rows, and there are as many tasks as the pairs need. No pair is lost or made twice."""
    count = lambda df, n: df.groupBy(*cell).agg(F.count("*").alias(n))
    work = stored(count(left, "_nl").join(count(right, "_nr"), cell).withColumn("_k", F.ceil(F.col("_nl").cast("double") * F.col("_nr") / TASK_PAIRS).cast("int")))
    pairs = work.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0.0
    tasks = max(min(math.ceil(pairs / TASK_PAIRS) * 2, MOST_TASKS), 1)
    work = work.select(*cell, "_k")
    hashed = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    left = left.join(work, cell).withColumn("_s", F.pmod(F.xxhash64(*hashed), F.col("_k")).cast("int")).drop("_k")
    right = right.join(work, cell).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    return left.repartition(tasks, *cell, "_s").join(right.repartition(tasks, *cell, "_s"), [*cell, "_s"]).drop("_s")


def _on_sphere(df: DataFrame, name: str, x: str, y: str) -> tuple[DataFrame, list[str]]:
    """With the place on the unit sphere as three columns."""
    lon, lat = F.radians(F.col(x)), F.radians(F.col(y))
    return df.withColumns({f"{name}x": F.cos(lat) * F.cos(lon), f"{name}y": F.cos(lat) * F.sin(lon), f"{name}z": F.sin(lat)}), [f"{name}{c}" for c in "xyz"]


def intersects_join(a: DataFrame, ga: str, b: DataFrame, gb: str, size: float) -> DataFrame:
    """Pairs with overlapping boxes: an equi-join on grid cells; a pair counts in the cell of its overlap's lower corner only."""
    left = a.withColumn("_ba", bbox(ga)).withColumn("_cell", F.explode(cells_of(F.col("_ba"), size)))
    right = b.withColumn("_bb", bbox(gb)).withColumn("_cell", F.explode(cells_of(F.col("_bb"), size)))
    own = (F.floor(F.greatest("_ba.x0", "_bb.x0") / size) == F.col("_cell.i")) & (F.floor(F.greatest("_ba.y0", "_bb.y0") / size) == F.col("_cell.j"))
    near = dealt_join(left.withColumns({"_i": F.col("_cell.i"), "_j": F.col("_cell.j")}), right.withColumns({"_i": F.col("_cell.i"), "_j": F.col("_cell.j")}).drop("_cell"), ["_i", "_j"])
    return near.where(bbox_overlap(F.col("_ba"), F.col("_bb")) & own).drop("_cell", "_ba", "_bb", "_i", "_j")


def dwithin_join(a: DataFrame, xa: str, ya: str, b: DataFrame, xb: str, yb: str, metres: float) -> DataFrame:
    """Point pairs at most ``metres`` apart. Cells are bands of latitude; each band has its own width in longitude, so the
    neighbourhood of a point is a few cells at any latitude, across the date line and at the poles too."""
    deg = math.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-12
    band_of = lambda y: F.floor((y + 90) / deg).cast("long")

    def columns(band: Column) -> Column:
        """Cells round the globe in a band: as many as fit, each at least as wide as the radius at the band's edge nearest a pole."""
        edge = F.least(F.greatest(F.abs((band - 1) * deg - 90), F.abs((band + 2) * deg - 90)), F.lit(90.0))
        wide = F.when(edge >= 89.9, 0).otherwise(F.floor(360 * F.cos(F.radians(edge)) / (2 * deg)))
        return F.greatest(wide, F.lit(1)).cast("long")

    place = lambda x, n: F.least(F.floor((F.pmod(x + 180, F.lit(360.0))) / 360 * n).cast("long"), n - 1)
    right = b.withColumn("_band", band_of(F.col(yb))).withColumn("_n", columns(F.col("_band"))).withColumn("_col", place(F.col(xb), F.col("_n")))
    left = a.withColumn("_band", F.explode(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: band_of(F.col(ya)) + d)))
    left = left.withColumn("_n", columns(F.col("_band"))).withColumn("_c", place(F.col(xa), F.col("_n")))
    left = left.withColumn("_col", F.explode(F.array_distinct(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.pmod(F.col("_c") + d, F.col("_n"))))))
    (left, la), (right, lb) = _on_sphere(left.drop("_n", "_c"), "_l", xa, ya), _on_sphere(right.drop("_n"), "_r", xb, yb)
    near = dealt_join(left, right, ["_band", "_col"])
    chord = sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(la[1:], lb[1:])), (F.col(la[0]) - F.col(lb[0])) * (F.col(la[0]) - F.col(lb[0])))
    most = 4 * math.sin(min(metres / EARTH_M, math.pi) / 2) ** 2
    # The squared chord settles all but what lies at the limit; there, the distance itself is computed.
    inside = F.when(chord > most * (1 + 1e-6) + 1e-12, False).when(chord < most * (1 - 1e-6) - 1e-12, True).otherwise(haversine(xa, ya, xb, yb) <= metres)
    return near.where(inside).drop("_band", "_col", *la, *lb)


def dwithin_filter(df: DataFrame, x: str, y: str, lon: float, lat: float, metres: float) -> DataFrame:
    """Rows at most ``metres`` from a place; the latitude range reaches the scan."""
    deg = math.degrees(metres / EARTH_M) * (1 + 1e-9)
    return df.where(F.col(y).between(lat - deg, lat + deg)).where(haversine(x, y, F.lit(lon), F.lit(lat)) <= metres)


def cluster_grid(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Centre and number of the points in each grid cell."""
    return df.groupBy(F.floor(F.col(x) / cell).alias("i"), F.floor(F.col(y) / cell).alias("j")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("members"))


def kernel_density(df: DataFrame, x: str, y: str, x0: float, y0: float, step: float, nx: int, ny: int, bandwidth: float) -> DataFrame:
    """Gaussian density at the points of a grid, the largest being 1: every grid point sums over the rows, map-side combined."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1)))
    at = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), grid.alias("g")).withColumn("i", F.col("g") % nx).withColumn("j", F.floor(F.col("g") / nx))
    d2 = F.pow(F.col("_x") - (x0 + F.col("i") * step), 2) + F.pow(F.col("_y") - (y0 + F.col("j") * step), 2)
    sums = at.groupBy("i", "j").agg(F.sum(F.exp(-d2 / (2 * bandwidth * bandwidth))).alias("s"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("s").alias("m")))).select("i", "j", (F.col("s") / F.col("m")).alias("density"))


def hex_cell(x, y, size: float) -> Column:
    """Axial coordinates of the hexagon (pointed top, ``size`` from centre to corner) that holds a planar place."""
    q, r = (math.sqrt(3) / 3 * _c(x) - _c(y) / 3) / size, (2.0 / 3 * _c(y)) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.struct(fq.cast("long").alias("q"), fr.cast("long").alias("r"))


def hex_ring(cell: Column, k: int) -> Column:
    """All cells at most k steps away."""
    moves = [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]
    return F.array(*(F.struct((cell["q"] + q).alias("q"), (cell["r"] + r).alias("r")) for q, r in moves))


def hex_center(cell: Column, size: float):
    """Planar place of a cell's centre: (x, y)."""
    return size * math.sqrt(3) * (cell["q"] + cell["r"] / 2), size * 1.5 * cell["r"]


def hex_size_for_radius(radius: float, rings: int = 1) -> float:
    """The least cell size with which ``rings`` rings round a place's cell hold everything within the radius."""
    return radius / (1.5 * rings)


def project(lon, lat, width: float, height: float):
    """Equirectangular place on a map of the given size: (x, y) from the upper left."""
    return (_c(lon) + 180) / 360 * width, (90 - _c(lat)) / 180 * height


# Cells on the faces of a cube round the globe: 3 bits of face, 5 of level, 28 each of column and row.

CUBE_LEVELS = 24


def cube_cell(lon, lat, level: int) -> Column:
    """The id of the cell of a level (2^level columns and rows a face) that holds a place."""
    lo, la = F.radians(_c(lon)), F.radians(_c(lat))
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), (ay >= az)
    face = F.when(on_x, F.when(x > 0, 0).otherwise(3)).when(on_y, F.when(y > 0, 1).otherwise(4)).otherwise(F.when(z > 0, 2).otherwise(5))
    u = F.when(on_x, y / ax).when(on_y, x / ay).otherwise(x / az)
    v = F.when(on_x, z / ax).when(on_y, z / ay).otherwise(y / az)
    n = 1 << level
    grid = lambda w: F.least(F.greatest(F.floor((w + 1) / 2 * n), F.lit(0)), F.lit(n - 1)).cast("long")
    return _cube_id(face.cast("long"), F.lit(level), grid(u), grid(v))


def _cube_id(face: Column, level: Column, i: Column, j: Column) -> Column:
    return F.shiftleft(face, 61).bitwiseOR(F.shiftleft(level.cast("long"), 56)).bitwiseOR(F.shiftleft(i, 28)).bitwiseOR(j)


def _cube_parts(cell: Column):
    ones = (1 << 28) - 1
    return F.shiftrightunsigned(cell, 61), F.shiftright(cell, 56).bitwiseAND(31), F.shiftright(cell, 28).bitwiseAND(ones), cell.bitwiseAND(ones)


def cube_ancestor(cell: Column, level: int) -> Column:
    """The cell of a coarser level that holds this one."""
    face, own, i, j = _cube_parts(cell)
    up = (own - level).cast("int")
    div = lambda w: F.floor(w / F.pow(F.lit(2.0), up)).cast("long")
    return _cube_id(face, F.lit(level), div(i), div(j))


def cube_neighborhood(cell: Column) -> Column:
    """The cell and those round it on its face, nine at most."""
    face, level, i, j = _cube_parts(cell)
    last = F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), level).cast("long") - 1
    moves = F.array(*(F.struct((i + a).alias("i"), (j + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    inside = F.filter(moves, lambda m: m["i"].between(0, last) & m["j"].between(0, last))
    return F.transform(inside, lambda m: _cube_id(face, level, m["i"], m["j"]))


def cube_level_for_radius(metres: float) -> int:
    """The finest level whose cells are everywhere at least as wide as the radius (a face's cells shrink to half at its corners)."""
    level = 0
    while level < CUBE_LEVELS and EARTH_M * 2 / (1 << (level + 1)) / 3 >= metres:
        level += 1
    return level
