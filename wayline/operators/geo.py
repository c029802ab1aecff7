"""Geometry on DataFrames: ellipsoidal UDFs (Arrow batches into numpy kernels) and plain column expressions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wayline.functions import geodesic as g

# types as objects: texts would need a running session on import
DOUBLE = T.DoubleType()


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, DOUBLE) for n in names])


COORDS = T.ArrayType(_doubles("lon", "lat"))


@pandas_udf(DOUBLE)
def distance(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Ellipsoidal metres between two points."""
    return pd.Series(g.distance(lon1.to_numpy(), lat1.to_numpy(), lon2.to_numpy(), lat2.to_numpy()))


@pandas_udf(DOUBLE)
def intercept(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
    """Unclamped fraction of a-b nearest to c."""
    return pd.Series(g.intercept(*(s.to_numpy() for s in (ax, ay, bx, by, cx, cy))))


@pandas_udf(_doubles("lon", "lat"))
def interpolate(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, f: pd.Series) -> pd.DataFrame:
    """Point at a fraction of a-b."""
    x, y = g.interpolate(*(s.to_numpy() for s in (ax, ay, bx, by, f)))
    return pd.DataFrame({"lon": x, "lat": y})


@pandas_udf(DOUBLE)
def azimuth(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, f: pd.Series) -> pd.Series:
    """Azimuth at a fraction of a-b."""
    return pd.Series(g.azimuth(*(s.to_numpy() for s in (ax, ay, bx, by, f))))


@pandas_udf(_doubles("west", "south", "east", "north"))
def envelope(lon: pd.Series, lat: pd.Series, radius: pd.Series) -> pd.DataFrame:
    """Box of a circle."""
    return pd.DataFrame(dict(zip(("west", "south", "east", "north"), g.envelope(lon.to_numpy(), lat.to_numpy(), radius.to_numpy()), strict=True)))


@pandas_udf(_doubles("lon", "lat"))
def intersect(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.DataFrame:
    """Crossing of the geodesics a-b and c-d."""
    x, y = g.intersect(*(s.to_numpy() for s in (ax, ay, bx, by, cx, cy, dx, dy)))
    return pd.DataFrame({"lon": x, "lat": y})


def _lines(coords: pd.Series):
    for c in coords:
        yield g.Line([p["lon"] for p in c], [p["lat"] for p in c]) if c is not None and len(c) else None


@pandas_udf(DOUBLE)
def line_length(coords: pd.Series) -> pd.Series:
    """Ellipsoidal length of polylines."""
    n = np.array([0 if c is None else len(c) for c in coords])
    x = np.array([p["lon"] for c in coords if c is not None for p in c])
    y = np.array([p["lat"] for c in coords if c is not None for p in c])
    if len(x) < 2:
        return pd.Series(np.zeros(len(n)))
    d = np.concatenate([[0.0], g.distance(x[:-1], y[:-1], x[1:], y[1:])])
    row = np.repeat(np.arange(len(n)), n)
    d[np.concatenate([[True], row[1:] != row[:-1]])] = 0.0
    return pd.Series(np.bincount(row, weights=d, minlength=len(n)))


@pandas_udf(_doubles("frac", "distance"))
def line_intercept(coords: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    """Fraction of a polyline closest to a point, and the distance."""
    got = [(None, None) if line is None else line.intercept(x, y) for line, x, y in zip(_lines(coords), lon, lat, strict=True)]
    return pd.DataFrame(got, columns=["frac", "distance"])


@pandas_udf(_doubles("lon", "lat"))
def line_interpolate(coords: pd.Series, f: pd.Series) -> pd.DataFrame:
    """Point at a fraction of a polyline."""
    return pd.DataFrame([(None, None) if line is None else line.interpolate(x) for line, x in zip(_lines(coords), f, strict=True)], columns=["lon", "lat"])


@pandas_udf(DOUBLE)
def line_azimuth(coords: pd.Series, f: pd.Series) -> pd.Series:
    """Azimuth at a fraction of a polyline."""
    return pd.Series([None if line is None or len(line.x) < 2 else line.azimuth(x) for line, x in zip(_lines(coords), f, strict=True)], dtype=float)


def heading_difference(a: Column, b: Column) -> Column:
    """Smaller angle between two headings, in [0, 180]."""
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def reverse_line(coords: Column) -> Column:
    return F.reverse(coords)


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_line(coords: Column) -> Column:
    """LINESTRING of coordinates; EMPTY for none."""
    pairs = F.concat_ws(", ", F.transform(coords, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))))
    return F.when(F.size(coords) > 0, F.concat(F.lit("LINESTRING ("), pairs, F.lit(")"))).otherwise(F.lit("LINESTRING EMPTY"))


def wkt_multiline(lines: Column) -> Column:
    one = lambda c: F.concat(F.lit("("), F.concat_ws(", ", F.transform(c, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))), F.lit(")"))
    return F.concat(F.lit("MULTILINESTRING ("), F.concat_ws(", ", F.transform(lines, one)), F.lit(")"))


def coords_of_wkt(wkt: Column) -> Column:
    """Coordinates of a POINT or LINESTRING text; an empty array for EMPTY or other texts, null for null."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    pairs = F.regexp_extract_all(F.when(wkt.rlike(r"(?i)^\s*(SRID=\d+;)?\s*(POINT|LINESTRING)"), wkt).otherwise(F.when(wkt.isNotNull(), F.lit(""))), F.lit(rf"({number})\s+({number})"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("lon"), F.split(p, r"\s+")[1].cast("double").alias("lat")))


@pandas_udf(T.BinaryType())
def to_wkb(coords: pd.Series) -> pd.Series:
    """WKB linestrings (little-endian) of coordinates."""
    return pd.Series([None if c is None else struct.pack(f"<BII{2 * len(c)}d", 1, 2, len(c), *(v for p in c for v in (p["lon"], p["lat"]))) for c in coords])


@pandas_udf(COORDS)
def from_wkb(data: pd.Series) -> pd.Series:
    """Coordinates of WKB linestrings of either byte order; null for other geometries."""
    out = []
    for b in data:
        c = None
        if b is not None and len(b) >= 9:
            b = bytes(b)
            e = "<" if b[0] == 1 else ">"
            kind, n = struct.unpack_from(e + "II", b, 1)
            if kind == 2 and len(b) >= 9 + 16 * n:
                v = struct.unpack_from(f"{e}{2 * n}d", b, 9)
                c = [{"lon": v[2 * i], "lat": v[2 * i + 1]} for i in range(n)]
        out.append(c)
    return pd.Series(out)


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against one ring, edges straight in degrees; the box is tested first."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            odd = odd + ((F.lit(y1) > lat) != (F.lit(y2) > lat)).cast("int") * (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1).cast("int")
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & (F.pmod(odd, F.lit(2)) == 1)


def coords_in_polygon(coords: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether all vertices of a line lie in a ring (exact for convex rings)."""
    return F.forall(coords, lambda p: in_polygon(p["lon"], p["lat"], ring))


def geojson_points(points: Column) -> Column:
    """GeoJSON MultiPoint text of coordinates."""
    return F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


def geojson_lines(lines: Column) -> Column:
    """GeoJSON MultiLineString text of arrays of coordinates."""
    return F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(lines, lambda c: F.transform(c, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")))
