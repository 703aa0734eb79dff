"""Single-band rasters as a struct column; cells are row-major from the upper left."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

RASTER = "struct<width:int,height:int,ulx:double,uly:double,sx:double,sy:double,srid:int,band:array<double>>"


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def make_empty(width, height, ulx, uly, sx, sy, srid=0) -> Column:
    """All cells 0; the y scale is stored negative (rows go down)."""
    w, h = _c(width).cast("int"), _c(height).cast("int")
    return F.struct(
        w.alias("width"), h.alias("height"), _c(ulx).cast("double").alias("ulx"), _c(uly).cast("double").alias("uly"),
        F.abs(_c(sx).cast("double")).alias("sx"), (-F.abs(_c(sy).cast("double"))).alias("sy"), _c(srid).cast("int").alias("srid"), F.array_repeat(F.lit(0.0), w * h).alias("band"),
    )


def width(r) -> Column:
    return _c(r)["width"]


def height(r) -> Column:
    return _c(r)["height"]


def _inside(r: Column, x: Column, y: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < r["width"]) & (y < r["height"])


def value(r, x, y) -> Column:
    """A cell by column and row from 0; null outside."""
    r, x, y = _c(r), _c(x), _c(y)
    return F.when(_inside(r, x, y), F.get(r["band"], (y * r["width"] + x).cast("int")))


def set_value(r, x, y, v) -> Column:
    """The raster with one cell changed; an error outside."""
    r, x, y = _c(r), _c(x), _c(y)
    at = y * r["width"] + x
    band = F.transform(r["band"], lambda old, i: F.when(i == at, _c(v).cast("double")).otherwise(old))
    return F.when(_inside(r, x, y), r.withField("band", band)).otherwise(F.raise_error(F.lit("cell outside the raster")).cast(RASTER))


def as_raster(geometry, sx: float, sy: float, v: float = 1.0) -> Column:
    """A parsed polygon (or other geometry's box) as cells of ``v``: those whose centre lies in the outer ring."""
    from . import geo

    g = _c(geometry)
    box = geo.bbox(g)
    w = F.greatest(F.ceil((box["x1"] - box["x0"]) / sx), F.lit(1)).cast("int")
    h = F.greatest(F.ceil((box["y1"] - box["y0"]) / sy), F.lit(1)).cast("int")

    def cell(i: Column) -> Column:
        x = box["x0"] + (i % w + 0.5) * sx
        y = box["y1"] - (F.floor(i / w) + 0.5) * sy
        inside = geo.st_contains(g, geo.st_point(x, y))
        return F.when(F.coalesce(inside, F.lit(True)), F.lit(float(v))).otherwise(0.0)

    band = F.transform(F.sequence(F.lit(0), w * h - 1), cell)
    return F.struct(w.alias("width"), h.alias("height"), box["x0"].alias("ulx"), box["y1"].alias("uly"), F.lit(float(sx)).alias("sx"), F.lit(-float(sy)).alias("sy"), geo.st_srid(g).alias("srid"), band.alias("band"))


def _to_hex(r):
    if r is None:
        return None
    return struct.pack("<IIddddI", r["width"], r["height"], r["ulx"], r["uly"], r["sx"], r["sy"], r["srid"]).hex() + struct.pack(f"<{len(r['band'])}d", *r["band"]).hex()


def to_hex(r) -> Column:
    """Little-endian header and cells as hex text."""
    return F.udf(_to_hex, "string", useArrow=True)(_c(r))


def _from_hex(text):
    if not text:
        return None
    raw = bytes.fromhex(text)
    head = struct.unpack_from("<IIddddI", raw)
    at = struct.calcsize("<IIddddI")
    return dict(zip(("width", "height", "ulx", "uly", "sx", "sy", "srid"), head)) | {"band": list(struct.unpack_from(f"<{head[0] * head[1]}d", raw, at))}


def from_hex(text) -> Column:
    return F.udf(_from_hex, RASTER, useArrow=True)(_c(text))
