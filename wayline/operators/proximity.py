"""Points near other points, and regions around points: tiled, salted dual-tree joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.dualtree import near_pairs, points_in_polygons
from wayline.functions.geometry import EARTH_RADIUS_M, normal_lon

#: Rows of one side that one task of a tile is meant to hold.
TILE_ROWS = 50_000


def band_of(lat: Column, size: float) -> Column:
    return F.floor((lat + 90.0) / size).cast("long")


def columns_of(band: Column, size: float) -> Column:
    """Number of tiles round the globe in a band, so that tiles stay about square up to the poles."""
    low, high = F.abs(band * size - 90.0), F.abs((band + 1) * size - 90.0)
    return F.greatest(F.lit(1.0), F.floor(360.0 / size * F.cos(F.radians(F.least(F.lit(90.0), F.greatest(low, high)))))).cast("long")


def _tile(lon: Column, columns: Column) -> Column:
    return F.least(F.floor((lon + 180.0) / 360.0 * columns).cast("long"), columns - 1)


def tiles(points: DataFrame, size: float, reach_m: float = 0.0) -> DataFrame:
    """Adds band and tile: the tile of each point (lon in [-180, 180), lat), or all tiles within ``reach_m`` of it, across the 180th meridian."""
    if not reach_m:
        own = points.withColumn("band", band_of(F.col("lat"), size)).withColumn("__n", columns_of(F.col("band"), size))
        return own.withColumn("tile", _tile(F.col("lon"), F.col("__n"))).drop("__n")
    dlat = float(np.degrees(reach_m / EARTH_RADIUS_M)) * 1.001
    lat = F.col("lat")
    x = points.withColumn("band", F.explode(F.sequence(band_of(F.greatest(lat - dlat, F.lit(-90.0)), size), band_of(F.least(lat + dlat, F.lit(90.0)), size))))
    x = x.withColumn("__n", columns_of(F.col("band"), size))
    edge = F.least(F.lit(89.999999), F.abs(lat) + dlat)
    dlon = F.lit(dlat) / F.cos(F.radians(edge))
    wide = (F.abs(lat) + 2 * dlat >= 90.0) | (dlon >= 180.0)
    first = F.when(wide, F.lit(0)).otherwise(F.floor((F.col("lon") - dlon + 180.0) / 360.0 * F.col("__n"))).cast("long")
    last = F.when(wide, F.col("__n") - 1).otherwise(F.floor((F.col("lon") + dlon + 180.0) / 360.0 * F.col("__n"))).cast("long")
    last = F.least(last, first + F.col("__n") - 1)
    return x.withColumn("tile", F.explode(F.sequence(first, last))).withColumn("tile", F.pmod("tile", F.col("__n"))).drop("__n")


def _salted(left: DataFrame, right: DataFrame, by: list[str], key_l: str, key_r: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Split hot tiles on both sides: salts sl, sr such that each (tile, sl, sr) holds about ``rows`` rows of either side."""
    n_l = left.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("nl"))
    n_r = right.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("nr"))
    parts = n_l.join(n_r, by)  # tiles with both sides only
    all_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    l = left.join(parts, by).withColumn("sl", F.pmod(F.xxhash64(key_l), F.col("nl")).cast("int")).withColumn("sr", all_("nr")).drop("nl", "nr")
    r = right.join(parts, by).withColumn("sr", F.pmod(F.xxhash64(key_r), F.col("nr")).cast("int")).withColumn("sl", all_("nl")).drop("nl", "nr")
    return l, r


def _xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return EARTH_RADIUS_M * np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def near_points(left: DataFrame, right: DataFrame, radius_m: float, size: float | None = None, rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (left_key, right_key) at most ``radius_m`` great-circle metres apart; left and right have key (long), lon, lat.

    Rows with null position or key match nothing; longitudes count modulo 360; repeated rows give repeated pairs; empty sides give none.
    Left points go to their tile, right points to all tiles within the radius, tiles with many rows are split on both sides, and a
    dual-tree kernel joins each part: so any pair meets in exactly one task, however dense the place.
    """
    size = size or max(0.01, float(np.degrees(radius_m / EARTH_RADIUS_M)) * 20)
    clean = lambda df: df.where("key is not null and lon is not null and lat between -90 and 90").select(F.col("key").cast("long").alias("key"), normal_lon(F.col("lon")).alias("lon"), "lat")
    # new names give new columns, so that a table may be joined with itself
    right = clean(right).select((F.col("key") + 0).alias("key"), (F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat"))
    by = ["band", "tile"]
    l, r = _salted(tiles(clean(left), size), tiles(right, size, radius_m), by, "key", "key", rows)
    chord = 2 * EARTH_RADIUS_M * float(np.sin(radius_m / EARTH_RADIUS_M / 2))

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy()
        found = list(near_pairs(_xyz(get(a, "lon"), get(a, "lat")), _xyz(get(b, "lon"), get(b, "lat")), chord))
        i = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
        j = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"left_key": get(a, "key")[i], "right_key": get(b, "key")[j]}, schema=pa.schema([("left_key", pa.int64()), ("right_key", pa.int64())]))

    group = [*by, "sl", "sr"]
    return l.groupBy(*group).cogroup(r.groupBy(*group)).applyInArrow(kernel, "left_key long, right_key long")


def polygon_edges(wkt: str | None) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of all rings of a WKT POLYGON or MULTIPOLYGON; none for anything else."""
    if not wkt or "POLYGON" not in wkt.upper():
        return np.zeros((0, 4))
    out = []
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        p = np.array([[float(x) for x in c.split()[:2]] for c in ring.split(",")])
        if len(p) and (p[0] != p[-1]).any():
            p = np.vstack([p, p[:1]])
        out.append(np.hstack([p[:-1], p[1:]]))
    return np.vstack(out) if out else np.zeros((0, 4))


def zones_around(points: DataFrame, zones: DataFrame, rows: int = TILE_ROWS, finest: float = 0.02) -> DataFrame:
    """Pairs (left_key, right_key): point (key, lon, lat) lies in zone (key, geom WKT POLYGON or MULTIPOLYGON).

    Edges are straight in degrees, holes are outside, longitudes count modulo 360. A zone is registered in the square tiles under its
    box, of the finest size (0.02 degrees times a power of 4) at which that is at most 3 x 3; points go to one tile of each
    size in use (at most 8). Null positions, keys and geometries match nothing; malformed geometries are no zone.
    """
    number = r"-?\d+\.?\d*(?:[eE][-+]?\d+)?"
    pairs = F.regexp_extract_all("geom", F.lit(rf"({number})\s+({number})"), F.lit(0))
    z = (
        zones.where("key is not null and upper(geom) like '%POLYGON%'").select(F.col("key").cast("long").alias("key"), "geom", pairs.alias("c"))
        .withColumn("xs", F.expr("transform(c, p -> try_cast(split(p, '\\\\s+')[0] as double))")).withColumn("ys", F.expr("transform(c, p -> try_cast(split(p, '\\\\s+')[1] as double))"))
        .select("key", "geom", *(f(c).alias(n) for n, f, c in (("x0", F.array_min, "xs"), ("x1", F.array_max, "xs"), ("y0", F.array_min, "ys"), ("y1", F.array_max, "ys"))))
        .where("x0 is not null and y0 is not null")
    )
    need = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    z = z.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(F.greatest(need, F.lit(1e-9)) / (2 * finest)) / float(np.log(4.0)))).cast("int")).withColumn("size", finest * F.pow(F.lit(4.0), F.col("level")))
    cell = lambda c: F.floor(F.col(c) / F.col("size")).cast("long")
    # the zone shifted by whole turns, so that points in [-180, 180) meet it
    z = z.withColumn("turn", F.explode(F.sequence(F.floor((F.col("x0") + 180.0) / 360.0).cast("int"), F.floor((F.col("x1") + 180.0) / 360.0).cast("int"))))
    z = z.withColumn("x0", F.greatest(F.col("x0") - 360.0 * F.col("turn"), F.lit(-180.0))).withColumn("x1", F.least(F.col("x1") - 360.0 * F.col("turn"), F.lit(180.0)))
    z = z.withColumn("band", F.explode(F.sequence(cell("y0"), cell("y1")))).withColumn("tile", F.explode(F.sequence(cell("x0"), cell("x1"))))
    levels = sorted(r[0] for r in z.select("level").distinct().collect())  # at most about 8: powers of 4 up to the globe
    if not levels:
        return points.sparkSession.createDataFrame([], "left_key long, right_key long")
    p = points.where("key is not null and lon is not null and lat is not null").select(F.col("key").cast("long").alias("key"), normal_lon(F.col("lon")).alias("lon"), "lat")
    p = p.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels)))).withColumn("size", finest * F.pow(F.lit(4.0), F.col("level")))
    p = p.withColumn("band", cell("lat")).withColumn("tile", cell("lon")).drop("size")
    by = ["level", "band", "tile"]
    l, r = _salted(p, z.select("key", "geom", "turn", *by), by, "key", "key", rows)

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        lon, lat, key = (a.column(c).to_numpy() for c in ("lon", "lat", "key"))
        zone, turn = b.column("key").to_numpy(), b.column("turn").to_numpy()
        edges = [polygon_edges(w) - np.array([360.0 * t, 0, 360.0 * t, 0]) for w, t in zip(b.column("geom").to_pylist(), turn, strict=True)]
        found = list(points_in_polygons(np.column_stack([lon, lat]), edges))
        i = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
        k = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"left_key": key[i], "right_key": zone[k]}, schema=pa.schema([("left_key", pa.int64()), ("right_key", pa.int64())]))

    group = [*by, "sl", "sr"]
    return l.groupBy(*group).cogroup(r.groupBy(*group)).applyInArrow(kernel, "left_key long, right_key long")
