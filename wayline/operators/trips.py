"""Stops and trips from noisy location pings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geometry import located
from wayline.functions.motion import STAY, longest_stays, metres, plane, records, smallest_circle, smooth_and_decode
from wayline.functions.times import utc_micros
from wayline.session import cut

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
#: Rows of a chunk: its stops, its silences, its length, and the pings of what its rims may cut.
PIECES = pa.schema(
    [("kind", pa.string()), ("id", pa.string()), ("b", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("region", pa.int32()), ("open_l", pa.bool_()), ("open_r", pa.bool_()),
     ("lon", pa.float64()), ("lat", pa.float64()), ("v", pa.list_(pa.float64()))]
)
PIECES_DDL = "kind string, id string, b long, t1 long, t2 long, region int, open_l boolean, open_r boolean, lon double, lat double, v array<double>"
#: Running sums over a chunk's own pings: metres, pings, unit vector of the place, pings that the decoding holds for staying.
LENGTH, COUNT, X, Y, Z, STAYING = range(6)
#: Regions of up to so many pings go to the join of chunks as they are.
PLAIN_PINGS = 64


def flat(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plane coordinates in metres whose near differences are right: the origin moves on where the way leaves 500 m round it."""
    x, y = plane(lon, lat, lon[0], lat[0])
    i = 0
    while True:
        away = np.flatnonzero((np.abs(x[i:] - x[i]) > 500) | (np.abs(y[i:] - y[i]) > 500))
        if not len(away):
            return x, y
        k = i + int(away[0])
        dx, dy = plane(lon[k:], lat[k:], lon[k], lat[k])
        x[k:], y[k:] = x[k] + dx, y[k] + dy
        i = k


def needed(lon: np.ndarray, lat: np.ndarray, radius_m: float) -> np.ndarray:
    """Positions of the pings that decide every longest stretch of a region.

    The region is cut into blocks that a circle holds. No longest stretch lies strictly inside such a block, so each takes a beginning, an end or
    all of it: the pings outside the hull of those before them in the block, and of those after them, hold the same circles as all. The pings
    next to them stay as well, as stretches end there.
    """
    n = len(lon)
    if n <= PLAIN_PINGS:
        return np.arange(n)
    x, y = flat(lon, lat)
    keep, i = [], 0
    while i < n:
        j = _block_end(x, y, i, radius_m)
        px, py = x[i:j], y[i:j]
        ahead, back = i + records(px, py), j - 1 - records(px[::-1], py[::-1])
        keep += [ahead, np.maximum(ahead - 1, i), back, np.minimum(back + 1, j - 1)]
        i = j
    return np.unique(np.concatenate(keep))


def _block_end(x: np.ndarray, y: np.ndarray, i: int, radius_m: float) -> int:
    """End of a stretch from ping i that a circle holds; as long as doubling and bisection find it."""
    fits = lambda k: smallest_circle(x[i:k], y[i:k])[2] <= radius_m
    n, k = len(x), i + 1
    while k < n and fits(min(n, i + 2 * (k - i))):
        k = min(n, i + 2 * (k - i))
    low, high = k, min(n, i + 2 * (k - i))
    while low < high:
        m = (low + high + 1) // 2
        low, high = (m, high) if fits(m) else (low, m - 1)
    return low


def kernel(table: pa.Table, radius_m: float, stay_us: int, silence_us: int, wild_mps: float) -> pa.Table:
    """Stops, silences, lengths and rim pings of chunks; rows of a chunk (id, b) lie together in order of t."""
    ids = table.column("id").combine_chunks().dictionary_encode()
    code, b, t = ids.indices.to_numpy(), table.column("b").to_numpy(), table.column("t").to_numpy()
    lon, lat, own = table.column("lon").to_numpy(), table.column("lat").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
    # a neighbour may also lie in the halo
    new = np.r_[True, (code[1:] != code[:-1]) | (b[1:] != b[:-1])]
    keep = new | np.r_[True, t[1:] != t[:-1]]
    code, b, t, lon, lat, own, new = (v[keep] for v in (code, b, t, lon, lat, own, new))
    # single wild fixes: too fast both from the ping before and to the ping after
    step, dt = metres(lon[:-1], lat[:-1], lon[1:], lat[1:]), np.diff(t) / 1e6
    fast = (step > wild_mps * dt) & ~new[1:]
    wild = np.r_[False, fast] & np.r_[fast, False]
    group = np.cumsum(new)
    code, b, t, lon, lat, own, group = (v[~wild] for v in (code, b, t, lon, lat, own, group))
    new = np.r_[True, group[1:] != group[:-1]]
    silent = np.r_[True, np.diff(t) > silence_us] & ~new
    seg = np.flatnonzero(new | silent)
    s_lon, s_lat, _, state = smooth_and_decode(t / 1e6, lon, lat, seg, np.r_[seg[1:], len(t)])
    inc = np.r_[0.0, metres(s_lon[:-1], s_lat[:-1], s_lon[1:], s_lat[1:])]
    inc[seg] = 0.0

    # from here on only the chunks' own pings count
    linked = ~(new | silent)
    code, b, t, lon, lat, s_lon, s_lat, inc = (v[own] for v in (code, b, t, lon, lat, s_lon, s_lat, inc))
    group, staying, silent = group[own], (state == STAY)[own] & linked[own], silent[own]
    n = len(t)
    if not n:
        return PIECES.empty_table()
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], n] - 1
    p, q = np.radians(s_lon), np.radians(s_lat)
    own_sums = np.column_stack([inc, np.ones(n), np.cos(q) * np.cos(p), np.cos(q) * np.sin(p), np.sin(q), staying])
    sums = np.cumsum(own_sums, axis=0)
    base = np.repeat(sums[first] - own_sums[first], last - first + 1, axis=0)
    sums -= base

    seg = np.flatnonzero(np.r_[True, group[1:] != group[:-1]] | silent)
    seg_end = np.r_[seg[1:], n]
    seg_of = np.repeat(np.arange(len(seg)), seg_end - seg)
    regions = _regions(t, lon, lat, staying, seg, seg_end, seg_of, first, last, radius_m, stay_us)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first], is_last[last] = True, True

    stops: list[tuple] = []
    pings: list[np.ndarray] = []
    marks: list[tuple] = []
    for number, (i, j) in enumerate(regions):
        if is_first[i] or is_last[j]:
            k = i + needed(lon[i : j + 1], lat[i : j + 1], radius_m)
            pings.append(k)
            marks.append((number, is_first[i], is_last[j], len(k)))
            continue
        if t[j] - t[i] < stay_us:
            continue
        x, y = flat(lon[i : j + 1], lat[i : j + 1])
        for u, v in longest_stays(t[i : j + 1], x, y, radius_m, stay_us):
            u, v = u + i, v + i
            own_sum = sums[v] - sums[u] + own_sums[u]
            stops.append((u, v, *_place(own_sum), [sums[u, LENGTH], sums[v, LENGTH], own_sum[COUNT], own_sum[STAYING]]))

    out = [_rows("length", ids, code[first], b[first], t[first], t[last], sums[last][:, [LENGTH]])]
    k = np.flatnonzero(silent)
    out.append(_rows("silence", ids, code[k], b[k], t[k], t[k], np.zeros((len(k), 0))))
    if stops:
        u, v = (np.array([s[c] for s in stops]) for c in (0, 1))
        out.append(_rows("stop", ids, code[u], b[u], t[u], t[v], np.array([s[4] for s in stops]), lon=np.array([s[2] for s in stops]), lat=np.array([s[3] for s in stops])))
    if pings:
        k = np.concatenate(pings)
        size = [m[3] for m in marks]
        spread = lambda c: np.repeat(np.array([m[c] for m in marks]), size)
        out.append(_rows("ping", ids, code[k], b[k], t[k], t[k], np.hstack([sums[k], own_sums[k]]), lon=lon[k], lat=lat[k], region=spread(0), open_l=spread(1), open_r=spread(2)))
    return pa.concat_tables(out)


def _place(sums: np.ndarray) -> tuple[float, float]:
    """Mean place of summed unit vectors: lon, lat."""
    x, y, z = sums[X], sums[Y], sums[Z]
    return float(np.degrees(np.arctan2(y, x))), float(np.degrees(np.arctan2(z, np.hypot(x, y))))


def _rows(kind: str, ids: pa.DictionaryArray, code, b, t1, t2, v: np.ndarray, lon=None, lat=None, region=None, open_l=None, open_r=None) -> pa.Table:
    n = len(code)
    col = lambda a, kind: pa.nulls(n, kind) if a is None else pa.array(a, kind)
    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * v.shape[1], np.ascontiguousarray(v).ravel())
    cols = [pa.array([kind] * n, pa.string()), ids.dictionary.take(pa.array(code)), col(b, pa.int64()), col(t1, pa.int64()), col(t2, pa.int64()), col(region, pa.int32())]
    return pa.Table.from_arrays([*cols, col(open_l, pa.bool_()), col(open_r, pa.bool_()), col(lon, pa.float64()), col(lat, pa.float64()), lists], schema=PIECES)


def _regions(t, lon, lat, staying, seg, seg_end, seg_of, first, last, radius_m: float, stay_us: int) -> list[tuple[int, int]]:
    """Stretches of pings (first, last) outside of which there is no stop; in order, disjoint.

    The decoded stays are seeds, and so is what the decoding calls moving although a cheap bound cannot rule a stop out: pings whose next ones, for the
    least duration, come back within reach. A chunk's first and last pings are seeds as well, as a rim may cut a stop. Every seed takes the pings
    next to it that a circle could hold together with one of its own.
    """
    reach = 2 * radius_m + 0.01
    seeds: list[tuple[int, int]] = []
    follows = np.r_[False, seg_of[1:] == seg_of[:-1]]
    runs = lambda flag: (np.flatnonzero(flag & ~(np.r_[False, flag[:-1]] & follows)), np.flatnonzero(flag & ~(np.r_[flag[1:], False] & np.r_[follows[1:], False])))
    lo, hi = runs(staying)
    for i, j in zip(np.maximum(lo - 1, seg[seg_of[hi]]).tolist(), hi.tolist(), strict=True):
        a, z, s0, s1 = i, j, seg[seg_of[j]], seg_end[seg_of[j]] - 1
        while a > s0 and step_within(lon, lat, a - 1, i, reach):
            a -= 1
        while z < s1 and step_within(lon, lat, z + 1, j, reach):
            z += 1
        seeds.append((a, z))
    # the first ping a stay later, and one about half a stay later, are within reach
    span = t[seg_end - 1] - t[seg] + 2 * stay_us
    clock = t - t[seg][seg_of] + np.r_[0, np.cumsum(span)[:-1]][seg_of]
    after, half = np.searchsorted(clock, clock + stay_us), np.searchsorted(clock, clock + stay_us // 2)
    near = after < seg_end[seg_of]
    for w in (after, half):
        k = np.flatnonzero(near)
        near[k] = metres(lon[k], lat[k], lon[w[k]], lat[w[k]]) <= reach
    for i, j in zip(*(v.tolist() for v in runs(near)), strict=True):
        z, s1 = int(after[j]), seg_end[seg_of[j]] - 1
        while z < s1 and step_within(lon, lat, z + 1, j, reach):
            z += 1
        seeds.append((i, z))
    for ends, at_end in ((first, False), (last, True)):
        of = np.repeat(ends, last - first + 1)
        away = (metres(lon, lat, lon[of], lat[of]) > reach) | (seg_of != seg_of[of])
        pos = np.arange(len(t))
        if at_end:
            rim = np.maximum.reduceat(np.where(away, pos, -1), first)
            seeds += [(max(int(r) + 1, int(f)), int(z)) for r, f, z in zip(rim, first, last, strict=True)]
        else:
            rim = np.minimum.reduceat(np.where(away, pos, len(t)), first)
            seeds += [(int(f), min(int(r) - 1, int(z))) for r, f, z in zip(rim, first, last, strict=True)]
    out: list[list[int]] = []
    for i, j in sorted(seeds):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def step_within(lon: np.ndarray, lat: np.ndarray, i: int, j: int, reach: float) -> bool:
    dy = (lat[i] - lat[j]) * 111195.0
    if dy > reach + 1 or dy < -reach - 1:
        return False
    return float(metres(lon[i], lat[i], lon[j], lat[j])) <= reach


class _Joiner:
    """Stops over the rims of chunks, from the rims' pings in order of id and time.

    A chain is a row of pings in which every chunk but the last reaches its end and every one but the first its begin, without a silence; it is
    searched like a region of one chunk. Its length grows with the time of one unbroken stay or slow movement, not with the pings of it.
    """

    COLUMNS = ("id", "b", "b2", "t1", "t2", "cum1", "cum2", "lon", "lat", "n", "staying")

    def __init__(self, radius_m: float, stay_us: int, silence_us: int):
        self.radius_m, self.stay_us, self.silence_us = radius_m, stay_us, silence_us
        self.held: pd.DataFrame | None = None

    def feed(self, pdf: pd.DataFrame | None) -> pd.DataFrame:
        """Stops of the chains that are complete; None: the rest."""
        x = pdf if self.held is None else self.held if pdf is None else pd.concat([self.held, pdf], ignore_index=True)
        out: list[tuple] = []
        if x is None or not len(x):
            return pd.DataFrame(out, columns=self.COLUMNS)
        code = pd.factorize(x["id"])[0]
        b, t, region = x["b"].to_numpy(), x["t1"].to_numpy(), x["region"].to_numpy()
        same = code[1:] == code[:-1]
        # inside a region not every ping is here
        inside = (b[1:] == b[:-1]) & (region[1:] == region[:-1])
        over = (b[1:] != b[:-1]) & x["open_r"].to_numpy(bool)[:-1] & x["open_l"].to_numpy(bool)[1:] & (t[1:] - t[:-1] <= self.silence_us)
        starts = np.r_[0, np.flatnonzero(~(same & (inside | over))) + 1]
        ends = np.r_[starts[1:], len(x)]
        if pdf is not None:
            self.held = x.iloc[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        else:
            self.held = None
        lon, lat = x["lon"].to_numpy(), x["lat"].to_numpy()
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            if t[j - 1] - t[i] >= self.stay_us:
                out += self._search(x["id"].iloc[i], b[i:j], t[i:j], lon[i:j], lat[i:j], np.vstack(x["v"].iloc[i:j].to_list()))
        return pd.DataFrame(out, columns=self.COLUMNS)

    def _search(self, key: str, b, t, lon, lat, v: np.ndarray) -> list[tuple]:
        sums, own = v[:, :6], v[:, 6:]
        # over all chunks of the chain: a chunk's last ping is in it if another follows
        turn = np.flatnonzero(b[1:] != b[:-1])
        total = np.zeros_like(sums)
        total[turn + 1] = sums[turn]
        total = sums + np.cumsum(total, axis=0)
        x, y = flat(lon, lat)
        out = []
        for i, j in longest_stays(t, x, y, self.radius_m, self.stay_us):
            s = total[j] - total[i] + own[i]
            out.append((key, int(b[i]), int(b[j]), int(t[i]), int(t[j]), sums[i, LENGTH], sums[j, LENGTH], *_place(s), int(round(s[COUNT])), int(round(s[STAYING]))))
        return out


def stops_and_trips(
    pings: DataFrame, id_col: str = "id", time_col: str = "time", point_col: str = "point", radius_m: float = 50.0, stay_s: float = 300.0,
    silence_s: float = 21_600.0, wild_mps: float = 80.0, chunk_us: int = DAY_US, halo_us: int = 2 * HOUR_US,
) -> DataFrame:
    """Stops and trips: (kind, id, start_ms, end_ms, duration_ms, distance_m, lon, lat, n_pings, stay_share).

    Pings with null id, time or point (or an empty or malformed one) do not count; of pings alike in id and time the least position
    counts. A single ping that needs more than ``wild_mps`` both from the ping before and to the one after is ignored. ``stop``: an unbroken
    stretch of pings, as long as possible, within ``radius_m`` of one place, at least ``stay_s`` long (of overlapping ones the longest in time); a
    silence of more than ``silence_s`` ends it. ``trip``: from the last ping of a stop to the first of the next, if no such silence lies between.
    Mean place, number of pings, and the share of them that the decoding holds for staying, are those of a stop (null for trips); distance
    follows the smoothed path. Empty tables give no row; other columns are ignored.

    The pings of an id are cut into chunks of time with a halo, so that a hot id spreads over the cluster. In each chunk a Kalman smoother
    gives position and speed and a two-state hidden Markov model decodes staying and moving. Around the decoded stays, and wherever else a
    cheap bound leaves room for a stop, smallest circles fix the exact ends. What a chunk's rim may cut is searched once more over the chunks.
    """
    # names of its own: the optimizer takes equal ones away in one use and not in the other
    named = pings.select(F.col(id_col).cast("string").alias("__id"), utc_micros(pings, time_col).alias("__t"), F.col(point_col).alias("__wkt")).where("__id is not null and __t is not null")
    got = (
        located(named, "__wkt").groupBy("__id", "__t").agg(F.min(F.struct("lon", "lat")).alias("__at"))
        .select(F.col("__id").alias("id"), F.col("__t").alias("t"), F.col("__at.lon").alias("lon"), F.col("__at.lat").alias("lat"))
    )
    # the outer explode keeps this branch alike to the one below, so that both read one exchange
    home = F.floor(F.col("t") / chunk_us)
    near = F.array_distinct(F.array(home, F.floor((F.col("t") - halo_us) / chunk_us), F.floor((F.col("t") + halo_us) / chunk_us)))
    spread = got.withColumn("home", home).select("id", F.explode_outer(near).alias("b"), "home", "t", "lon", "lat").withColumn("own", F.col("home") == F.col("b")).drop("home")
    # the neighbours of a chunk, however long the silence
    rims = got.withColumn("b", home).groupBy("id", "b").agg(F.min(F.struct("t", "lon", "lat")).alias("first"), F.max(F.struct("t", "lon", "lat")).alias("last"))
    w = Window.partitionBy("id").orderBy("b")
    beside = rims.select("id", "b", F.array(F.lag("last").over(w), F.lead("first").over(w)).alias("r")).select("id", "b", F.explode_outer("r").alias("r")).where("r is not null")
    spread = spread.unionByName(beside.select("id", "b", "r.t", "r.lon", "r.lat", F.lit(False).alias("own")))

    stay_us, silence_us = int(stay_s * 1e6), int(silence_s * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            t = pa.Table.from_batches(held)
            end = len(t)
            if not last:  # the chunk that may go on stays
                tail = t.select(["id", "b"])
                k_id, k_b = tail.column("id")[-1], tail.column("b")[-1]
                same = pa.compute.and_(pa.compute.equal(tail.column("id"), k_id), pa.compute.equal(tail.column("b"), k_b)).to_numpy(zero_copy_only=False)
                end = int(len(t) - same.sum())
            if end:
                yield from kernel(t.slice(0, end), radius_m, stay_us, silence_us, wild_mps).to_batches()
            held = t.slice(end).combine_chunks().to_batches() if end < len(t) else []
            n = sum(map(len, held))

        wait = 200_000
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= wait:
                yield from flush(False)
                wait = n + 200_000
        if n:
            yield from flush(True)

    pieces = cut(spread.repartition("id", "b").sortWithinPartitions("id", "b", "t").select("id", "b", "t", "lon", "lat", "own").mapInArrow(run, PIECES_DDL))
    whole = pieces.where("kind = 'stop'").select(
        "id", "b", F.col("b").alias("b2"), "t1", "t2", F.col("v")[0].alias("cum1"), F.col("v")[1].alias("cum2"), "lon", "lat", F.col("v")[2].cast("long").alias("n"), F.col("v")[3].cast("long").alias("staying")
    )

    def join_rims(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = _Joiner(radius_m, stay_us, silence_us)
        for pdf in frames:
            yield j.feed(pdf)
        yield j.feed(None)

    merged = (
        pieces.where("kind = 'ping'").repartition("id").sortWithinPartitions("id", "t1").select("id", "b", "t1", "region", "open_l", "open_r", "lon", "lat", "v")
        .mapInPandas(join_rims, "id string, b long, b2 long, t1 long, t2 long, cum1 double, cum2 double, lon double, lat double, n long, staying long")
    )
    chunk = pieces.where("kind = 'length'").select(
        "id", "b", "t1", F.lag("t2").over(w).alias("before"), F.coalesce(F.sum(F.col("v")[0]).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base")
    )
    stops = (
        whole.unionByName(merged)
        .join(chunk.select("id", "b", F.col("base").alias("base1")), ["id", "b"], "left")
        .join(chunk.select("id", F.col("b").alias("b2"), F.col("base").alias("base2")), ["id", "b2"], "left")
        .select("id", "t1", "t2", (F.col("cum1") + F.col("base1")).alias("d1"), (F.col("cum2") + F.col("base2")).alias("d2"), "lon", "lat", "n", "staying", F.lit(1).alias("is_stop"))
    )
    none = lambda t: F.lit(None).cast(t)
    # silences inside chunks, and between the last ping of a chunk and the first of the next
    quiet = pieces.where("kind = 'silence'").select("id", "t1").unionByName(chunk.where(F.col("t1") - F.col("before") > silence_us).select("id", "t1"))
    silences = quiet.select("id", "t1", F.col("t1").alias("t2"), *(none(k).alias(c) for c, k in (("d1", "double"), ("d2", "double"), ("lon", "double"), ("lat", "double"), ("n", "long"), ("staying", "long"))), F.lit(0).alias("is_stop"))
    v = Window.partitionBy("id").orderBy("t1", "is_stop")
    line = stops.unionByName(silences).select("*", F.lead("is_stop").over(v).alias("next"), F.lead("t1").over(v).alias("t3"), F.lead("d1").over(v).alias("d3")).where("is_stop = 1")
    ms = lambda c: F.floor(F.col(c) / 1000)
    stop_row = F.struct(
        F.lit("stop").alias("kind"), ms("t1").alias("start_ms"), ms("t2").alias("end_ms"), (F.col("d2") - F.col("d1")).alias("distance_m"), F.col("lon"), F.col("lat"), F.col("n").alias("n_pings"),
        (F.col("staying") / F.col("n")).alias("stay_share"),
    )
    trip_row = F.when(
        (F.col("next") == 1) & (F.col("t3") >= F.col("t2")),
        F.struct(
            F.lit("trip").alias("kind"), ms("t2").alias("start_ms"), ms("t3").alias("end_ms"), (F.col("d3") - F.col("d2")).alias("distance_m"), none("double").alias("lon"), none("double").alias("lat"),
            none("long").alias("n_pings"), none("double").alias("stay_share"),
        ),
    )
    return (
        line.select("id", F.explode(F.array(stop_row, trip_row)).alias("r")).where("r is not null")
        .select("r.kind", "id", "r.start_ms", "r.end_ms", (F.col("r.end_ms") - F.col("r.start_ms")).alias("duration_ms"), "r.distance_m", "r.lon", "r.lat", "r.n_pings", "r.stay_share")
    )
