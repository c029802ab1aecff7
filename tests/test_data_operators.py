"""Sessions, references, timestamps, proximity and trips against plain versions, and their edge cases."""

import datetime as dt
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions.dualtree import inside_rings, near_pairs, points_in_polygons
from wayline.functions.motion import longest_stays, metres, plane, smallest_circle
from wayline.operators.activity import sessions
from wayline.operators.proximity import near_points, polygon_edges, zones_around
from wayline.operators.references import orphan_references, orphan_report
from wayline.operators.timestamps import abbreviation_offsets, normalise_messages, normalise_sequences
from wayline.operators.trips import stops_and_trips

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def ms(seconds):
    return int((at(seconds) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


# sessions


def test_sessions_edges_and_copies(spark):
    # exactly 30 minutes do not split; copies count once; nulls do not count; sessions cross bucket rims
    rows = [("a", at(0)), ("a", at(1800)), ("a", at(1800)), ("a", at(3601)), ("b", at(86395)), ("b", at(86405)), (None, at(0)), ("c", None), ("d", at(5))]
    got = {tuple(r) for r in sessions(spark.createDataFrame(rows, "id string, time timestamp")).collect()}
    assert got == {("a", ms(0), ms(1800), 1_800_000, 2), ("a", ms(3601), ms(3601), 0, 1), ("b", ms(86395), ms(86405), 10_000, 2), ("d", ms(5), ms(5), 0, 1)}


def test_sessions_random_against_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{rng.integers(3)}", at(float(t))) for t in rng.integers(0, 500_000, 600)]
    rows += [("hot", at(float(t))) for t in np.cumsum(rng.integers(1, 2500, 400))]
    want = []
    for k in {r[0] for r in rows}:
        ts = sorted({r[1] for r in rows if r[0] == k})
        cur = [ts[0]]
        for t in [*ts[1:], None]:
            if t is None or (t - cur[-1]).total_seconds() > 1800:
                want.append((k, cur[0], cur[-1], len(cur)))
                cur = []
            cur.append(t)
    e = dt.datetime(1970, 1, 1)
    want = {(k, int((a - e).total_seconds() * 1000), int((b - e).total_seconds() * 1000), n) for k, a, b, n in want}
    df = spark.createDataFrame(rows, "id string, time timestamp").withColumn("b", F.lit(1)).withColumn("t", F.lit("x"))  # clashing names
    assert {(r.id, r.start_ms, r.end_ms, r.n_events) for r in sessions(df).collect()} == want


def test_sessions_empty(spark):
    assert sessions(spark.createDataFrame([], "id string, time timestamp")).count() == 0


# references


def test_references(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    nodes = spark.createDataFrame([(1, 1, t(1), True), (1, 2, t(5), True), (2, 1, t(1), True), (2, 2, t(2), False), (3, 4, t(9), True), (4, 1, None, True), (None, 1, t(1), True)], "id long, version int, tstamp timestamp, visible boolean")
    ways = spark.createDataFrame([(10, 1, t(1), True)], "id long, version int, tstamp timestamp, visible boolean")
    refs = spark.createDataFrame(
        [(10, 1, 0, t(3)), (10, 2, 1, t(3)), (10, 3, 2, t(3)), (10, 3, 3, t(9)), (10, 4, 4, t(1)), (10, 99, 5, None), (10, None, 6, t(3)), (11, 1, 0, t(3)), (10, 99, 5, None), (10, 3, 7, None)], "way_id long, node_id long, sequence_id int, tstamp timestamp"
    )
    got = sorted((r.ref_table, r.way_id, r.sequence_id, r.reason) for r in orphan_references(refs, nodes, ways).collect())
    assert got == [("nodes", 10, 1, "deleted"), ("nodes", 10, 2, "later"), ("nodes", 10, 5, "missing"), ("ways", 11, 0, "missing")]
    small = orphan_references(refs, nodes, ways, range_keys=1, batch_refs=1)
    assert sorted((r.ref_table, r.way_id, r.sequence_id, r.reason) for r in small.collect()) == got
    assert {(r.ref_table, r.period, r.reason, r.n_refs) for r in orphan_report(small).collect()} >= {("nodes", None, "missing", 1), ("ways", "2020-01-01", "missing", 1)}
    assert orphan_references(refs.limit(0), nodes, ways).count() == 0
    assert {r.reason for r in orphan_references(refs, nodes.limit(0), ways.limit(0)).collect()} == {"missing"}


# timestamps

ZONES = [("b", "Europe/Berlin", "dmy"), ("n", "America/New_York", "mdy"), ("k", "Asia/Kolkata", "dmy"), ("x", None, None)]


def us(text):
    d = dt.datetime.fromisoformat(text)
    return int((d - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    "dev, text, want",
    [
        ("b", "2024-07-01 12:00:00", "2024-07-01T10:00:00+00:00"), ("n", "07/04/2024 01:02:03 PM", "2024-07-04T17:02:03+00:00"), ("n", "07/04/2024 12:02:03 AM", "2024-07-04T04:02:03+00:00"),
        ("b", "04/07/2024 01:02:03", "2024-07-03T23:02:03+00:00"), ("n", "04.07.2024 01:02:03", "2024-07-04T05:02:03+00:00"), ("k", "2024-01-01 00:00:00 IST", "2023-12-31T18:30:00+00:00"),
        ("b", "2024-01-01t05:00:00z", "2024-01-01T05:00:00+00:00"), ("b", "20240101T050001Z", "2024-01-01T05:00:01+00:00"), ("b", "2024-01-01T05:00+01:00", "2024-01-01T04:00:00+00:00"),
        ("b", "Sun, 30 Oct 2016 02:05:40 +0100", "2016-10-30T01:05:40+00:00"), ("b", "1700000000", "2023-11-14T22:13:20+00:00"), ("b", "1700000000123", "2023-11-14T22:13:20.123+00:00"),
        ("b", "1700000000123456", "2023-11-14T22:13:20.123456+00:00"), ("b", "1700000000123456789", "2023-11-14T22:13:20.123456+00:00"), ("b", "1700000000.582", "2023-11-14T22:13:20.582+00:00"),
        ("b", "2024-01-01 00:00:00,999+0000", "2024-01-01T00:00:00.999+00:00"), ("b", "2024-01-01T00:00:00.123456789-03:30", "2024-01-01T03:30:00.123456+00:00"), ("b", "  2024-01-01 00:00:00 +01:00 ", "2023-12-31T23:00:00+00:00"),
        ("x", "2024-01-01T00:00:00+01:00[Europe/Berlin]", "2023-12-31T23:00:00+00:00"), ("b", "2024-03-31 02:30:00", "2024-03-31T01:30:00+00:00"), ("b", "2024-10-27 02:30:00 CET", "2024-10-27T01:30:00+00:00"),
        ("b", "2024-10-27 02:30:00 CEST", "2024-10-27T00:30:00+00:00"), ("b", "2024-01-01", "2023-12-31T23:00:00+00:00"),
        ("b", "2023-02-29 00:00:00", None), ("b", "31/02/2024 00:00:00", None), ("b", "0000-00-00 00:00:00", None), ("b", "", None), ("b", "  ", None), ("b", None, None), ("b", "soon", None), ("x", "2024-01-01 00:00:00", None),
        ("b", "2024-01-01 25:00:00", None), ("n", "13/04/2024 01:02:03", None), ("b", "2024-01-01 00:00:00 QQQ", None), ("zz", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00+00:00"), ("b", "2024-01-01 00:00:00Z trailing", None),
    ],
)
def test_notations(cases, dev, text, want):
    assert cases[dev, text] == (None if want is None else us(want))


@pytest.fixture(scope="module")
def cases(spark):
    marks = test_notations.pytestmark[0].args[1]
    rows = [(i, d, 1, t) for i, (d, t, _) in enumerate(marks)]
    out = normalise_sequences(spark.createDataFrame(rows, "row_no long, id string, seq int, time string"), spark.createDataFrame(ZONES, "id string, zone_name string, date_order string")).collect()
    assert len(out) == len(rows)
    by = {r.row_no: r.utc_us for r in out}
    return {(d, t): by[i] for i, d, _, t in rows}


def test_repeated_hour_in_order(spark):
    devices = spark.createDataFrame(ZONES, "id string, zone_name string, date_order string")
    text = ["02:50:00", "02:55:00", "02:05:00", "02:55:00", "03:00:00"]
    rows = [(i, "b", i, f"2024-10-27 {t}") for i, t in enumerate(text)] + [(99, "b", 2, "2024-10-27 02:05:00+01:00")]
    got = {r.row_no: r.utc_us for r in normalise_sequences(spark.createDataFrame(rows, "row_no long, id string, seq int, time string"), devices).collect()}
    want = ["00:50", "00:55", "01:05", "01:55", "02:00"]
    assert [got[i] for i in range(5)] == [us(f"2024-10-27T{w}:00+00:00") for w in want] and got[99] == got[2]
    # continuous sampling up to the change's end: the second pass
    rows = [(i, "b", i, f"2024-10-27 02:{50 + i}:00") for i in range(10)] + [(10, "b", 10, "2024-10-27 03:00:00")]
    got = {r.row_no: r.utc_us for r in normalise_sequences(spark.createDataFrame(rows, "row_no long, id string, seq int, time string"), devices).collect()}
    assert got[0] == us("2024-10-27T01:50:00+00:00")
    assert normalise_sequences(spark.createDataFrame([], "row_no long, id string, seq int, time string"), devices).count() == 0


def test_messages(spark):
    devices = spark.createDataFrame(ZONES, "id string, zone_name string, date_order string")
    r = dt.datetime(2024, 10, 27, 1, 0)
    rows = [
        (1, r, '{"time":"2024-10-27 02:30:00","id":"b","point":"x"}'), (2, r + dt.timedelta(hours=1), '{"id":"b","time":"2024-10-27 02:30:00"}'), (3, r, '{"id":"b","time":1700000000.582}'),
        (4, r, None), (5, r, "PING"), (6, r, ""), (7, r, "{}"), (8, r, '{"id":"b","time":null}'), (9, r, '{"id":"b","time":1700000000}'), (10, None, '{"id":"b","time":"2024-10-27 02:30:00"}'),
    ]
    got = {x.row_no: x.utc_us for x in normalise_messages(spark.createDataFrame(rows, "row_no long, received timestamp, body string"), devices).collect()}
    early, late = us("2024-10-27T00:30:00+00:00"), us("2024-10-27T01:30:00+00:00")
    assert got == {1: early, 2: late, 3: us("2023-11-14T22:13:20.582+00:00"), 4: None, 5: None, 6: None, 7: None, 8: None, 9: us("2023-11-14T22:13:20+00:00"), 10: early}


# proximity


def test_dual_tree_kernels():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 50, (700, 3)), np.vstack([rng.normal(0, 50, (500, 3)), np.zeros((60, 3))])
    got = {(int(i), int(j)) for x, y in near_pairs(a, b, 15.0) for i, j in zip(x, y, strict=True)}
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert got == set(map(tuple, np.argwhere(d <= 225).tolist()))
    n = sum(len(x) for x, _ in near_pairs(a, b, 15.0))
    assert n == len(got)
    e = polygon_edges("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))")
    xy = rng.uniform(-2, 12, (3000, 2))
    found = np.concatenate([i for i, _ in points_in_polygons(xy, [e])])
    assert sorted(found.tolist()) == np.flatnonzero(inside_rings(xy[:, 0], xy[:, 1], e)).tolist()
    assert list(near_pairs(a[:0], b, 5.0)) == [] and list(points_in_polygons(xy[:0], [e])) == []


def test_near_points_across_the_meridian_and_poles(spark):
    rng = np.random.default_rng(2)
    lon = np.concatenate([rng.uniform(179.9995, 180.0005, 150), rng.uniform(-180, 180, 100), np.full(40, 12.5)])
    lat = np.concatenate([rng.uniform(10, 10.001, 150), rng.uniform(89.9990, 90, 100), np.full(40, 50.0)])
    rows = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(zip(lon, lat, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (None, 1.0, 1.0), (901, 2.0, 95.0)], "key long, lon double, lat double")
    got = {(r[0], r[1]) for r in near_points(df, df, 20.0, rows=25).collect()}
    d = metres(lon[:, None], lat[:, None], lon[None], lat[None])
    assert got == set(map(tuple, np.argwhere(d <= 20).tolist()))
    assert near_points(df.limit(0), df, 20.0).count() == 0


def test_zones(spark):
    zones = [(1, "POLYGON((179.9 0, 180.1 0, 180.1 1, 179.9 1, 179.9 0))"), (2, "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0), (0.2 0.2, 0.8 0.2, 0.8 0.8, 0.2 0.8, 0.2 0.2)), ((5 5, 6 5, 6 6, 5 5)))"), (3, None), (4, "POLYGON EMPTY"), (5, "POLYGON((-170 -80, 170 -80, 170 80, -170 80, -170 -80))")]
    pts = [(10, -179.95, 0.5), (11, 179.95, 0.5), (12, 540.05, 0.5), (13, 0.1, 0.1), (14, 0.5, 0.5), (15, 5.7, 5.3), (16, None, 1.0), (17, 175.0, 5.0)]
    z = spark.createDataFrame(zones, "key long, geom string")
    got = {tuple(r) for r in zones_around(spark.createDataFrame(pts, "key long, lon double, lat double"), z).collect()}
    assert got == {(10, 1), (11, 1), (12, 1), (13, 2), (15, 2), (13, 5), (14, 5), (15, 5)}
    assert zones_around(spark.createDataFrame(pts, "key long, lon double, lat double"), z.limit(0)).count() == 0


# trips


def test_smallest_circle_and_stays():
    rng = np.random.default_rng(4)
    for _ in range(200):
        p = rng.normal(0, 10, (rng.integers(1, 30), 2))
        cx, cy, r = smallest_circle(p[:, 0], p[:, 1])
        assert np.hypot(p[:, 0] - cx, p[:, 1] - cy).max() <= r + 1e-6
        # no smaller circle: shifted centres do worse
        for s in rng.normal(0, 0.5, (20, 2)):
            assert np.hypot(p[:, 0] - cx - s[0], p[:, 1] - cy - s[1]).max() >= r - 1e-6
    t = np.arange(0, 1000, 60) * 1_000_000
    assert longest_stays(t, np.zeros(len(t)), np.zeros(len(t)), 50.0, 300_000_000) == [(0, len(t) - 1)]


def _drive():
    """A device: stay 10 min, drive, stay across midnight for 30 h with sparse pings, drive, silence of 7 h, stay."""
    rng = np.random.default_rng(5)
    rows, t, x = [], 0.0, 0.0

    def stay(seconds, every):
        nonlocal t
        for _ in range(int(seconds / every)):
            rows.append((t, x + rng.normal(0, 5), rng.normal(0, 5)))
            t += every

    def drive(seconds, speed):
        nonlocal t, x
        for _ in range(int(seconds / 10)):
            t += 10
            x += speed * 10
            rows.append((t, x, 0.0))
        t += 10
        x += speed * 10

    stay(600, 20)
    drive(600, 15)
    stay(30 * 3600, 600)
    drive(300, 12)
    t += 7 * 3600
    stay(900, 30)
    return rows


def test_trips_across_chunks_against_plain_search(spark):
    rows = _drive()
    lon = [9.0 + r[1] / 111195.08 / np.cos(np.radians(50)) for r in rows]
    lat = [50.0 + r[2] / 111195.08 for r in rows]
    data = [("a", at(r[0]), f"POINT({x:.7f} {y:.7f})") for r, x, y in zip(rows, lon, lat, strict=True)]
    wild = ("a", at(rows[5][0] + 7), "POINT(0 0)")
    df = spark.createDataFrame([*data, wild, data[3], ("a", None, "POINT(1 1)"), (None, at(0), "POINT(1 1)"), ("a", at(1), None), ("a", at(2), "POINT EMPTY"), ("b", at(0), "POINT(1 1)")], "id string, time timestamp, point string")
    got = {(r.kind, r.id, r.start_ms, r.end_ms) for r in stops_and_trips(df).collect()}
    t = np.array([int(r[0] * 1e6) for r in rows])
    x, y = plane(np.array(lon), np.array(lat), lon[0], lat[0])
    cut_at = int(np.flatnonzero(np.diff(t) > 6 * 3600e6)[0]) + 1
    want, prev = set(), None
    for a, b in ((0, cut_at), (cut_at, len(t))):
        prev = None
        for u, v in longest_stays(t[a:b], x[a:b], y[a:b], 50.0, 300_000_000):
            s, e = ms(0) + int(t[a + u] // 1000), ms(0) + int(t[a + v] // 1000)
            want.add(("stop", "a", s, e))
            if prev is not None:
                want.add(("trip", "a", prev, s))
            prev = e
    assert len([w for w in want if w[0] == "stop"]) == 3
    assert got == want
    d = [r.distance_m for r in stops_and_trips(df).where("kind = 'trip'").collect()]
    assert len(d) == 1 and abs(d[0] - 9150) < 300
    assert stops_and_trips(df.limit(0)).count() == 0


def _plain_stops(t, lon, lat, silence_us=21_600_000_000, wild=80.0):
    """Exhaustive search: all pings but the wild, cut at silences; of all stretches the longest first."""
    step, dt_s = metres(lon[:-1], lat[:-1], lon[1:], lat[1:]), np.diff(t) / 1e6
    fast = step > wild * dt_s
    ok = ~(np.r_[False, fast] & np.r_[fast, False])
    t, lon, lat = t[ok], lon[ok], lat[ok]
    out = []
    for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t) > silence_us) + 1):
        px, py = lon[part], lat[part]
        fits = lambda i, j: smallest_circle(*plane(px[i : j + 1], py[i : j + 1], px[i], py[i]))[2] <= 50.0 + 1e-6  # noqa: B023, E731
        spans, todo = [], [(0, len(part) - 1)]
        while todo:
            lo, hi = todo.pop()
            best, j = None, lo
            for i in range(lo, hi + 1):
                j = max(i, j)
                while j < hi and fits(i, j + 1):
                    j += 1
                d = t[part[j]] - t[part[i]]
                if d >= 300_000_000 and (best is None or d > best[0]):
                    best = d, i, j
            if best:
                spans.append(best[1:])
                todo += [(lo, best[1] - 1), (best[2] + 1, hi)]
        out += [(int(t[part[i]] // 1000), int(t[part[j]] // 1000), j - i + 1) for i, j in spans]
    return sorted(out)


def _random_drive(rng):
    """Stays, slow walks, drives and silences of any length, with noise, wild fixes and chunk rims in between."""
    t, x, y, rows = float(rng.integers(0, 80_000)), 0.0, 0.0, []
    for _ in range(int(rng.integers(3, 9))):
        kind, every = rng.integers(5), float(rng.choice([5, 30, 300, 1500]))
        n = int(rng.integers(2, 60))
        speed = {0: 0.0, 1: 0.0, 2: 0.15, 3: 1.2, 4: 15.0}[int(kind)]
        noise = float(rng.choice([0, 4, 20, 35]))
        turn = rng.uniform(0, 2 * np.pi)
        for _ in range(n):
            t += every * float(rng.uniform(0.5, 1.5))
            x, y = x + speed * every * np.cos(turn), y + speed * every * np.sin(turn)
            far = 1e6 if rng.random() < 0.02 else 0.0
            rows.append((int(t * 1e6), x + rng.normal(0, noise) + far, y + rng.normal(0, noise)))
        t += float(rng.choice([0, 600, 4 * 3600, 8 * 3600]))
    r = np.array(rows)
    return r[:, 0].astype(np.int64) + ms(0) * 1000, 10 + np.degrees(r[:, 1] / 6371008.8 / np.cos(np.radians(48))), 48 + np.degrees(r[:, 2] / 6371008.8)


def test_no_stop_is_lost(spark):
    rng = np.random.default_rng(9)
    drives = {f"r{k}": _random_drive(rng) for k in range(200)}
    deg = lambda m: m / 6371008.8 / np.pi * 180 / np.cos(np.radians(48))

    def between(times, places):
        """A drive, pings in two places, a drive."""
        t = np.array([*range(-300, 0, 10), *times, *range(int(times[-1]) + 10, int(times[-1]) + 310, 10)], float)
        d = np.array([*range(-6000, 0, 200), *places, *range(200 + 90, 6290, 200)], float)
        return (t * 1e6).astype(np.int64) + ms(40_000) * 1000, 10 + deg(d), np.full(len(t), 48.0)

    drives |= {"two": between([0, 3600], [0, 90]), "three": between([0, 1200, 2400], [0, 90, 0]), "flip": between([30 * k for k in range(40)], [90 * (k % 2) for k in range(40)]), "near": between([0, 600], [0, 40])}
    park = np.arange(4320) * 60_000_000 + ms(0) * 1000
    drives["park"] = park, 10 + deg(rng.normal(0, 4, 4320)), 48 + rng.normal(0, 4, 4320) / 111195.08
    # left for good at a chunk's rim, with pings just inside and outside the circle
    edge = np.r_[np.arange(0, 86_000, 600), np.arange(86_100, 87_000, 30)] * 1_000_000 + ms(0) * 1000
    drives["edge"] = edge, 10 + deg(np.r_[np.zeros(144), np.arange(30) * 12.0]), np.full(174, 48.0)
    rows = [(k, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(t)), f"POINT({x:.9f} {y:.9f})") for k, d in drives.items() for t, x, y in zip(*d, strict=True)]
    got: dict = {}
    for r in stops_and_trips(spark.createDataFrame(rows, "id string, time timestamp, point string")).where("kind = 'stop'").collect():
        got.setdefault(r.id, []).append((r.start_ms, r.end_ms, r.n_pings))
    for k, d in drives.items():
        x, y = (np.array([float(f"{v:.9f}") for v in c]) for c in d[1:])
        assert sorted(got.get(k, [])) == _plain_stops(d[0], x, y), k
    assert got["park"] == [(ms(0), ms(4319 * 60), 4320)] and all(len(got[k]) >= 1 for k in ("two", "three", "flip", "near"))


def test_records_hold_every_hull():
    from wayline.functions.motion import records

    rng = np.random.default_rng(4)
    for p in (rng.normal(0, 5, (500, 2)), np.round(rng.normal(0, 1, (400, 2))), np.column_stack([rng.integers(0, 5, 300), np.zeros(300)]).astype(float)):
        k = records(p[:, 0], p[:, 1])
        assert len(k) < len(p) / 3
        for m in (1, 2, 7, 50, 299):
            mine = k[k < m]
            assert abs(smallest_circle(p[:m, 0], p[:m, 1])[2] - smallest_circle(p[mine, 0], p[mine, 1])[2]) < 1e-6


def test_abbreviations_mean_what_they_meant_then(spark):
    uses = {(z, a): u for z, a, u in abbreviation_offsets(["Europe/Moscow", "Europe/Berlin", "no/where"])}
    assert [o for _, o in uses["Europe/Moscow", "MSK"]][-3:] == [10800, 14400, 10800] and [o for _, o in uses["Europe/Berlin", "CET"]] == [3600]
    rows = [(1, "m", 1, "2010-01-01 12:00:00 MSK"), (2, "m", 2, "2012-06-01 12:00:00 MSK"), (3, "m", 3, "2015-01-01 12:00:00 MSK"), (4, "b", 1, "2012-06-01 12:00:00 CET"), (5, "b", 2, "2012-06-01 12:00:00 CEST")]
    df = spark.createDataFrame(rows, "row_no long, id string, seq int, time string")
    devices = spark.createDataFrame([("m", "Europe/Moscow", "dmy"), ("b", "Europe/Berlin", "dmy")], "id string, zone_name string, date_order string")
    got = {r.row_no: r.utc_us for r in normalise_sequences(df, devices).collect()}
    assert got == {1: us("2010-01-01T09:00:00+00:00"), 2: us("2012-06-01T08:00:00+00:00"), 3: us("2015-01-01T09:00:00+00:00"), 4: us("2012-06-01T11:00:00+00:00"), 5: us("2012-06-01T10:00:00+00:00")}


def test_references_in_clusters_and_to_one_hot_key(spark):
    # parents in two far clusters, nine tenths of the references to one of them
    rng = np.random.default_rng(8)
    ids = np.r_[np.arange(5_000), 10**15 + np.arange(5_000)]
    nodes = spark.createDataFrame([(int(i), 1, T0, True) for i in ids[::2]], "id long, version int, tstamp timestamp, visible boolean")
    keys = np.where(rng.random(4_000) < 0.9, 10**15, rng.choice(ids, 4_000))
    refs = spark.createDataFrame([(1, int(k), n, T0) for n, k in enumerate(keys)], "way_id long, node_id long, sequence_id int, tstamp timestamp")
    ways = spark.createDataFrame([(1, 1, T0, True)], "id long, version int, tstamp timestamp, visible boolean")
    want = {n for n, k in enumerate(keys) if int(k) not in set(ids[::2].tolist())}
    for kw in ({}, {"range_keys": 100, "batch_refs": 300}, {"range_keys": 1, "batch_refs": 1000}):
        assert {r.sequence_id for r in orphan_references(refs, nodes, ways, **kw).collect()} == want
