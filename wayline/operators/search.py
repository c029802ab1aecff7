"""Radius, nearest and k-nearest search as tile joins; points on roads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geodesic as g
from wayline.functions.geometry import EARTH_RADIUS_M, haversine
from wayline.operators.proximity import band_of, columns_of, tiles
from wayline.session import cut, small_enough

_HALF_WAY = 2.1e7


def within(points: DataFrame, targets: DataFrame, radius_m: float) -> DataFrame:
    """(key, target, distance) of targets less than ``radius_m`` (strictly) from points; both sides have key, lon, lat.

    Filter and refine: the targets go to all tiles within the radius, the points to their own, tiles join by equality and the great-circle
    distance decides. Rows with null positions match nothing.
    """
    size = max(0.002, float(np.degrees(radius_m / EARTH_RADIUS_M)) * 2)
    a = tiles(points.where("lon is not null and lat is not null").select("key", "lon", "lat"), size)
    b = tiles(targets.where("lon is not null and lat is not null").select(F.col("key").alias("target"), "lon", "lat"), size, radius_m)
    b = b.select("target", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), "band", "tile")
    d = haversine(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat"))
    return a.join(b, ["band", "tile"]).select("key", "target", d.alias("distance")).where(F.col("distance") < radius_m)


def nearest(points: DataFrame, targets: DataFrame, k: int = 1, ties: bool = True, start_m: float = 100.0) -> DataFrame:
    """(key, target, distance, rank) of the k nearest targets of each point.

    The radius doubles for the points that have fewer than k targets within it, until none is left or the radius spans the globe; so a
    point gets all targets if there are fewer than k. ``ties``: equal distances share a rank (k = 1: all nearest); else the smaller target first.
    """
    targets = cut(targets.where("lon is not null and lat is not null").select("key", "lon", "lat"))
    rest, r, out = points.where("lon is not null and lat is not null").select("key", "lon", "lat").dropDuplicates(["key"]), start_m, None
    while True:
        w = Window.partitionBy("key")
        hits = within(rest, targets, r).withColumn("n", F.count("*").over(w)) if r < _HALF_WAY else _all(rest, targets).withColumn("n", F.lit(k))
        order = w.orderBy("distance") if ties else w.orderBy("distance", "target")
        found = cut(hits.where(F.col("n") >= k).withColumn("rank", (F.rank() if ties else F.row_number()).over(order)).where(F.col("rank") <= k).select("key", "target", "distance", "rank"))
        out = found if out is None else out.unionByName(found)
        if r >= _HALF_WAY:
            return out
        rest = cut(rest.join(found.select("key").distinct(), "key", "left_anti"))
        if rest.isEmpty():
            return out
        r = r * 2 if r < 1e6 else _HALF_WAY


def _all(points: DataFrame, targets: DataFrame) -> DataFrame:
    """The last resort for points without k targets within 1000 km: all targets, in 64 blocks on either side of an equality join."""
    a = points.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    b = targets.select(F.col("key").alias("target"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat")).withColumn("b", F.pmod(F.xxhash64("target"), F.lit(64)).cast("int"))
    return a.join(b, "b").select("key", "target", haversine(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat")).alias("distance"))


def road_segments(base: DataFrame) -> DataFrame:
    """Straight pieces of base roads: (road, seg, ax, ay, bx, by)."""
    x = base.select(F.col("id").alias("road"), F.posexplode(F.arrays_zip(F.slice("coords", 1, F.size("coords") - 1).alias("a"), F.slice("coords", 2, F.size("coords") - 1).alias("b"))).alias("seg", "s"))
    return x.select("road", "seg", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"))


#: Places of one tile that one task is meant to hold.
TILE_PLACES = 2_000


def roads_within(points: DataFrame, base: DataFrame, radius_m: float, rows: int = TILE_PLACES) -> DataFrame:
    """(key, road, frac, distance, lon, lat, azimuth): base roads less than ``radius_m`` (strictly, ellipsoidal) from points (key, lon, lat), with fraction, place and
    forward azimuth of the closest point.

    Segments are cut into pieces no longer than a tile, long ones from coarse to fine and only where there are points, and register in the tiles within the
    radius of the pieces. A point lies in one tile, so one task sees all its roads: a plain estimate drops most pairs, the foot on each piece left is
    computed, and the first best piece of a road counts. Tiles with many points are split, with all their pieces. Null positions match nothing.
    """

    def rest(a: pa.Table, b: pa.Table, row: np.ndarray, at: np.ndarray, found: list[np.ndarray]) -> list[pa.Array]:
        return [a.column("key").take(pa.array(row)), b.column("road").take(pa.array(at)), *map(pa.array, found)]

    return _by_tile(points, base, radius_m, rows, None, rest, "road")


def road_points_within(points: DataFrame, base: DataFrame, roads: DataFrame, radius_m: float, least: bool = False, rows: int = TILE_PLACES) -> DataFrame:
    """``road_points`` of ``roads_within`` in one go: (key, edge, frac, distance, lon, lat, azimuth), lifted to directed roads where they are found.

    ``least``: without the candidates that others of their point stand for, as ``matcher.minset`` has it; keys must be unique then. A task sees
    all roads of its points, so the ends of the roads and the numbers of roads that leave them are all that is needed.
    """
    back = F.col("heading") == "backward"
    pick = lambda c, of: F.max(F.when(of, F.col(c)))
    lift = roads.groupBy(F.col("base_id").alias("road")).agg(pick("id", ~back).alias("forth"), pick("id", back).alias("back"), *([pick("source", ~back).alias("s0"), pick("target", ~back).alias("t0"), pick("source", back).alias("s1"), pick("target", back).alias("t1")] if least else []))
    if least:
        leaving = roads.where("source is not null").groupBy(F.col("source").alias("v")).agg(F.count("*").alias("n"))
        for k in "01":
            lift = lift.join(leaving.select(F.col("v").alias(f"t{k}"), F.col("n").alias(f"n{k}")), f"t{k}", "left")

    def rest(a: pa.Table, b: pa.Table, row: np.ndarray, at: np.ndarray, found: list[np.ndarray]) -> list[pa.Array]:
        take = lambda c, i, none=-1: b.column(c).combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)[i]
        ways = [np.flatnonzero(b.column(c).is_valid().to_numpy()[at]) for c in ("forth", "back")]
        pair = np.concatenate(ways)
        turned = np.repeat([False, True], [len(w) for w in ways])
        frac, azimuth = found[0][pair], found[4][pair]
        frac, azimuth = np.where(turned, 1.0 - frac, frac), np.where(turned, (azimuth + 180.0) % 360.0, azimuth)
        edge = np.concatenate([take(c, at[w]) for c, w in zip(("forth", "back"), ways, strict=True)])
        row = row[pair]
        if least:
            ends = [np.concatenate([take(f"{c}{k}", at[w], 0) for k, w in zip("01", ways, strict=True)]) for c in "stn"]
            known = [np.concatenate([b.column(f"{c}{k}").is_valid().to_numpy()[at[w]] for k, w in zip("01", ways, strict=True)]) for c in "st"]
            kept = np.flatnonzero(_least(row, np.round(frac, 8), *ends, *known))
            pair, frac, azimuth, edge, row = pair[kept], frac[kept], azimuth[kept], edge[kept], row[kept]
        return [a.column("key").take(pa.array(row)), *map(pa.array, (edge, frac, found[1][pair], found[2][pair], found[3][pair], azimuth))]

    return _by_tile(points, base, radius_m, rows, lift, rest, "edge")


def _least(row: np.ndarray, f: np.ndarray, source: np.ndarray, target: np.ndarray, leaving: np.ndarray, has_source: np.ndarray, has_target: np.ndarray) -> np.ndarray:
    """Which candidates stay: not those at 0 that follow a candidate of their row, nor those at 1 that only candidates beyond their begin follow."""
    if not len(row):
        return np.zeros(0, bool)
    _, node = np.unique(np.concatenate([source, target]), return_inverse=True)
    n = len(row)
    wide = np.int64(node.max() + 1)
    begin, end = row * wide + node[:n], row * wide + node[n:]
    follows = np.isin(begin, end[has_target]) & has_source
    beyond, times = np.unique(begin[has_source & (f > 0)], return_counts=True)
    at = np.minimum(np.searchsorted(beyond, end), max(0, len(beyond) - 1))
    hits = np.where(beyond[at] == end, times[at], 0) if len(beyond) else np.zeros(n, np.int64)
    return ~((f == 0) & follows) & ~((f == 1) & (np.where(has_target, leaving - hits, 0) == 0))


def _by_tile(points: DataFrame, base: DataFrame, radius_m: float, rows: int, more: DataFrame | None, rest: Callable, name: str) -> DataFrame:
    """The tiles of ``roads_within``, each with its places and pieces in one task. more: columns by road that go with the pieces (roads without any are left out);
    rest: makes the columns of the result of places, pieces, the rows of both and what was found there."""
    finest = max(0.0015, float(np.degrees(radius_m / EARTH_RADIUS_M)) * 2)
    places = cut(tiles(points.where("lon is not null and lat is not null").select("key", "lon", "lat"), finest))
    seg = cut(_pieces(_measured(road_segments(base)), float(np.radians(finest)) * EARTH_RADIUS_M))
    levels = sorted((r[0] for r in seg.select("level").distinct().collect()), reverse=True)  # at most 9: tiles grow fourfold up to the globe
    key = points.schema["key"].dataType.simpleString()
    schema = f"key {key}, {name} long, frac double, distance double, lon double, lat double, azimuth double"
    if not levels:
        return points.sparkSession.createDataFrame([], schema)
    # long pieces are refined only where there are points: those in tiles without any are dropped, level by level
    live = None
    for level in range(levels[0], 0, -1):
        own = seg.where(F.col("level") == level)
        live = own if live is None else live.unionByName(own)
        size = finest * 4**level
        taken = _few(tiles(places.select("lon", "lat"), size).select("band", "tile").distinct())
        live = _halves(cut(_in_tiles(live, size, radius_m).join(taken, ["band", "tile"], "left_semi").drop("band", "tile").distinct()))
    last = seg.where("level = 0")
    live = last if live is None else live.unionByName(last)
    by = ["band", "tile"]
    parts = _few(places.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")))
    l = places.join(parts, by).withColumn("part_no", F.pmod(F.xxhash64("key", "lon", "lat"), F.col("parts")).cast("int")).drop("parts")
    # the segment's own ends, so that segments which share one are equally near
    end = lambda at, c, own: F.when(F.col(at) == float(own[0] == "b"), F.col(own)).otherwise(F.col(c)).alias(c)
    ends = [end("f0", "px", "ax"), end("f0", "py", "ay"), end("f1", "qx", "bx"), end("f1", "qy", "by")]
    pieces = _in_tiles(live, finest, radius_m).select(*by, "road", "seg", "f0", "f1", "offset", "part", "total", *ends)
    r = pieces.join(parts, by)
    if more is not None:
        r = r.join(more, "road")
    r = r.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    group = [*by, "part_no"]
    used = ("road", "seg", "f0", "f1", "offset", "part", "total", "px", "py", "qx", "qy")
    names = [f.split()[0] for f in schema.split(", ")]

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        row, at, found = _tile_feet({c: a.column(c).to_numpy() for c in ("lon", "lat")}, {c: b.column(c).to_numpy() for c in used}, radius_m)
        return pa.Table.from_arrays(rest(a, b, row, at, found), names=names)

    return l.groupBy(*group).cogroup(r.groupBy(*group)).applyInArrow(kernel, schema)


def _few(found: DataFrame) -> DataFrame:
    """Tiles with places: sent to the pieces if they are few, so that pieces elsewhere go before any shuffle."""
    return F.broadcast(found) if small_enough(found) else found


def _tile_feet(p: dict, s: dict, radius_m: float, block: int = 65_536) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of points and of pieces, and (frac, distance, lon, lat, azimuth), of every point's roads within the radius; one row per point and road."""
    n, m = len(p["lon"]), len(s["road"])
    got: list[tuple] = []
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * 5
    # in their order along the roads; a piece lies on its segment's geodesic, so the nearest foot on a piece is the segment's
    order = np.lexsort((s["f0"], s["seg"], s["road"]))
    s = {c: v[order] for c, v in s.items()}
    road_no = np.cumsum(np.r_[True, s["road"][1:] != s["road"][:-1]])
    # a plain estimate first: the distance from the straight piece, less what it may bend
    turn = lambda d: (d + 180.0) % 360.0 - 180.0
    lon0 = p["lon"][0]
    x, y, px = turn(p["lon"] - lon0), p["lat"], turn(s["px"] - lon0)
    dx, dy = turn(s["qx"] - s["px"]), s["qy"] - s["py"]
    plain = max(np.abs(x).max(), np.abs(px).max()) < 90
    lean = 111_320.0**2 * 3 / (8 * EARTH_RADIUS_M)
    step = max(1, block // m)
    for i in range(0, n, step):
        lat = y[i : i + step]
        k = np.cos(np.radians(lat))
        tan = np.abs(np.tan(np.radians(np.minimum(85.0, np.abs(lat)))))
        if k.max() < 1.002 * k.min():  # one scale for all, within what the estimate leaves
            k, tan = k.mean(), tan.max()
        else:
            k, tan = k[:, None], tan[:, None]
        k2 = k * k
        q = k2 * (dx * dx) + dy * dy
        vx, vy = x[i : i + step, None] - px, lat[:, None] - s["py"]
        if not plain:
            vx = turn(vx)
        t = vx * (k2 * dx / np.where(q > 0, q, 1))
        t += vy * (dy / np.where(q > 0, q, 1))
        np.clip(t, 0, 1, out=t)
        vx -= t * dx
        vy -= t * dy
        vx *= vx
        vx *= k2
        vy *= vy
        vx += vy
        row, at = np.nonzero(vx < ((radius_m * 1.022 + 1 + q * lean * (1 + tan)) / 111_320.0) ** 2)
        row += i
        f, d, foot = g.feet_of(*(s[c][at] for c in ("px", "py", "qx", "qy")), p["lon"][row], p["lat"][row])
        # the first best piece of a road
        hit = np.flatnonzero(d < radius_m)
        if not len(hit):
            continue
        r, o, h = row[hit], road_no[at[hit]], d[hit]
        begin = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])])
        size = np.diff(np.r_[begin, len(hit)])
        best = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, begin), size))
        whose = np.repeat(np.arange(len(begin)), size)[best]
        hit = hit[best[np.r_[True, whose[1:] != whose[:-1]]]]
        row, at, f = row[hit], at[hit], f[hit]
        f = np.where(f == 1, s["f1"][at], s["f0"][at] + f * (s["f1"][at] - s["f0"][at]))
        total = s["total"][at]
        frac = np.where(total > 0, (s["offset"][at] + f * s["part"][at]) / np.where(total > 0, total, 1), 0.0)
        got.append((row, order[at], frac, d[hit], *foot(hit)))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * 5
    row, at, *rest = (np.concatenate(c) for c in zip(*got, strict=True))
    return row, at, rest


def _measured(seg: DataFrame) -> DataFrame:
    """Adds offset, part and total: ellipsoidal metres before, along and over all segments of a road."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = g.distance(*(b.column(n).to_numpy() for n in ("ax", "ay", "bx", "by"))) if len(b) else np.zeros(0)
            yield b.append_column("part", pa.array(d))

    with_part = seg.mapInArrow(run, "road long, seg int, ax double, ay double, bx double, by double, part double")
    w = Window.partitionBy("road")
    return with_part.withColumn("offset", F.coalesce(F.sum("part").over(w.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("part").over(w))


_PLACED = ("f0", "f1", "px", "py", "qx", "qy")


def _in_tiles(pieces: DataFrame, size: float, radius_m: float) -> DataFrame:
    """Pieces with all tiles (band, tile) of ``size`` within the radius of them."""
    # besides the radius: what a long piece may bend away from the straight line in degrees
    pad = float(np.degrees(radius_m / EARTH_RADIUS_M)) * 1.01 + 0.0153 * size * size
    low_y, high_y = F.least("py", "qy") - pad, F.greatest("py", "qy") + pad
    lon_pad = F.lit(pad) / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("py"), F.abs("qy")) + pad)))
    # one across the 180th meridian turns about its first end
    turned = F.col("px") + F.pmod(F.col("qx") - F.col("px") + 180.0, F.lit(360.0)) - 180.0
    x = pieces.withColumn("band", F.explode(F.sequence(band_of(F.greatest(low_y, F.lit(-90.0)), size), band_of(F.least(high_y, F.lit(90.0)), size)))).withColumn("n", columns_of(F.col("band"), size))
    low = F.floor((F.least(F.col("px"), turned) - lon_pad + 180.0) / 360.0 * F.col("n")).cast("long")
    high = F.floor((F.greatest(F.col("px"), turned) + lon_pad + 180.0) / 360.0 * F.col("n")).cast("long")
    x = x.withColumn("tile", F.explode(F.sequence(low, F.least(high, low + F.col("n") - 1)))).withColumn("tile", F.pmod("tile", F.col("n"))).drop("n")
    return x


def _pieces(seg: DataFrame, finest_m: float) -> DataFrame:
    """Adds level, f0, f1 (fractions of the segment) and the ends p and q: one row per piece, at most ``finest_m`` times 4 to the level long, with the least level at which a segment has at most 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part").to_numpy()
            level = np.maximum(0, np.ceil(np.log(np.maximum(part, 1.0) / (64 * finest_m)) / np.log(4))).astype(np.int32)
            n = np.maximum(1, np.ceil(part / (finest_m * 4.0**level))).astype(np.int64)
            row = np.repeat(np.arange(len(b)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield from _placed(b, row, k / n[row], (k + 1) / n[row], level[row])

    return seg.mapInArrow(run, _piece_columns(seg))


def _halves(pieces: DataFrame) -> DataFrame:
    """Every piece cut in four, one level down."""
    plain = [f.name for f in pieces.schema if f.name not in (*_PLACED, "level")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, k = np.repeat(np.arange(len(b)), 4), np.tile(np.arange(4), len(b))
            a, z = b.column("f0").to_numpy()[row], b.column("f1").to_numpy()[row]
            yield from _placed(b.select(plain), row, a + (z - a) * k / 4, a + (z - a) * (k + 1) / 4, (b.column("level").to_numpy() - 1)[row])

    return pieces.mapInArrow(run, _piece_columns(pieces.select(*plain)))


def _piece_columns(seg: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seg.schema) + ", level int, " + ", ".join(f"{c} double" for c in _PLACED)


def _placed(b: pa.RecordBatch, row: np.ndarray, f0: np.ndarray, f1: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(row), 50_000):
        e = slice(s, s + 50_000)
        ends = [b.column(c).to_numpy()[row[e]] for c in ("ax", "ay", "bx", "by")]
        p, q = g.interpolate(*ends, f0[e]), g.interpolate(*ends, f1[e])
        made = map(pa.array, (level[e].astype(np.int32), f0[e], f1[e], *p, *q))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row[e])) for c in b.schema.names), *made], names=[*b.schema.names, "level", *_PLACED])


def road_points(hits: DataFrame, roads: DataFrame) -> DataFrame:
    """Lifts hits of ``roads_within`` to directed roads: (key, edge, frac, distance, lon, lat, azimuth): forward at frac and, where there is one, backward at 1 - frac."""
    r = roads.select(F.col("base_id").alias("road"), F.col("id").alias("edge"), (F.col("heading") == "backward").alias("back"))
    turned = F.when(F.col("back"), F.pmod(F.col("azimuth") + 180.0, F.lit(360.0))).otherwise(F.col("azimuth"))
    return hits.join(r, "road").select("key", "edge", F.when(F.col("back"), 1.0 - F.col("frac")).otherwise(F.col("frac")).alias("frac"), "distance", "lon", "lat", turned.alias("azimuth"))
