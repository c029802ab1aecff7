"""Geometry, search, network, matching, filter, clustering and tracking: golden values, brute force, and online = offline."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geodesic as g
from wayline.functions.hmm import Memory, State, step
from wayline.functions.network import Network, Targets, route_geometry
from wayline.operators import cluster, evaluation, geo, matcher, osm, roadmap, routing, search
from wayline.sources import roads as src
from wayline.sources import samples as smp
from wayline.streaming import tracker

# geometry

# Two lines with a point each, and the fraction, length and distance that must come out.
LINE1 = "11.4047013 48.1402147,11.4047038 48.1402718,11.4047661 48.1403687,11.4053519 48.141055,11.4054617 48.1411901,11.4062664 48.1421968,11.4064586 48.1424479,11.4066449 48.1427372,11.4067254 48.1429028,11.4067864 48.1430673,11.4068647 48.1433303,11.4069456 48.1436822,11.4070524 48.1440368,11.4071569 48.1443314,11.4072635 48.1445915,11.4073887 48.1448641,11.4075228 48.1450729,11.407806 48.1454843,11.4080135 48.1458112,11.4083012 48.1463167,11.4086211 48.1469061,11.4087461 48.1471386,11.4088719 48.1474078,11.4089422 48.1476014,11.409028 48.1478353,11.409096 48.1480701,11.4091568 48.1483459,11.4094282 48.1498536"
LINE2 = "11.5852021 48.1761996, 11.585284 48.175924, 11.5852937 48.1758945"


def _line(text):
    return [tuple(map(float, p.split())) for p in text.split(",")]


@pytest.mark.parametrize(
    "line, point, frac, length, distance",
    [(LINE1, (11.410624, 48.144161), 0.5175157549609246, 1138.85464239099, 252.03375312704165), (LINE2, (11.584009286555187, 48.17578656762985), 0.801975106391962, 34.603061318901396, 95.96239015496631)],
)
def test_golden_lines(spark, line, point, frac, length, distance):
    p = _line(line)
    x = g.Line(*zip(*p, strict=True))
    f, d = x.intercept(*point)
    assert abs(f - frac) < 1e-7 and abs(x.length - length) < 1e-5 and abs(d - distance) < 1e-5
    df = spark.createDataFrame([([{"lon": a, "lat": b} for a, b in p], *point)], "c array<struct<lon: double, lat: double>>, lon double, lat double")
    r = df.select(geo.line_intercept("c", "lon", "lat").alias("i"), geo.line_length("c").alias("l")).first()
    assert abs(r["i"]["frac"] - frac) < 1e-7 and abs(r["l"] - length) < 1e-5


def test_geodesics():
    rng = np.random.default_rng(0)
    lon, lat, az, d = rng.uniform(-180, 180, 200), rng.uniform(-80, 80, 200), rng.uniform(0, 360, 200), rng.uniform(1, 5e6, 200)
    x, y, arrival = g.direct(lon, lat, az, d)
    back, forward, there = g.inverse(lon, lat, x, y)
    assert np.allclose(back, d, atol=1e-4) and np.allclose((forward - az + 180) % 360 - 180, 0, atol=1e-6) and np.allclose((there - arrival + 180) % 360 - 180, 0, atol=1e-6)
    # the foot of the perpendicular is nearest, and inside or outside as its fraction says
    ax, ay, bx, by, cx, cy = 11.0, 48.0, 11.1, 48.05, 11.04, 48.05
    f = float(g.intercept(ax, ay, bx, by, cx, cy))
    at = lambda q: float(g.distance(*g.interpolate(ax, ay, bx, by, q), cx, cy))
    assert at(f) <= min(at(f - 1e-4), at(f + 1e-4))
    assert float(g.intercept(ax, ay, bx, by, 10.9, 47.9)) < 0 < 1 < float(g.intercept(ax, ay, bx, by, 11.3, 48.1)) and float(g.intercept(1, 1, 1, 1, 2, 2)) == 0
    px, py = g.intersect(11, 48, 11.1, 48.1, 11, 48.1, 11.1, 48)
    assert abs(float(g.intercept(11, 48, 11.1, 48.1, px, py)) - 0.5) < 1e-3 and at(0) > 0
    w, s, e, n = g.envelope(11, 48, 100.0)
    assert abs(float(g.distance(w, 48, 11, 48)) - 100) < 0.01 and abs(float(g.distance(11, n, 11, 48)) - 100) < 1e-6 and w < 11 < e and s < 48 < n
    assert math.isclose(float(g.azimuth(11, 48, 11, 49, 0.5)), 0.0, abs_tol=1e-9)


def test_columns(spark):
    az = [-0.1, -359.9, -360.1, 360, 360.1, 720.1, -719.9, -720.1]
    got = [r[0] for r in spark.createDataFrame([(float(a),) for a in az], "a double").select(smp.normal_azimuth(F.col("a"))).collect()]
    assert np.allclose(got, [359.9, 0.1, 359.9, 0, 0.1, 0.1, 0.1, 359.9])
    df = spark.createDataFrame([([{"lon": 1.5, "lat": 2.0}, {"lon": 3.0, "lat": 4.25}],)], "c array<struct<lon: double, lat: double>>")
    r = df.select(geo.wkt_line(F.col("c")).alias("w"), geo.from_wkb(geo.to_wkb("c")).alias("b"), geo.coords_of_wkt(geo.wkt_line(F.col("c"))).alias("t"), "c", geo.reverse_line(F.col("c")).alias("r"), geo.geojson_points(F.col("c")).alias("j"), geo.wkt_multiline(F.array("c")).alias("m"), geo.geojson_lines(F.array("c")).alias("n")).first()
    assert r["w"] == "LINESTRING (1.5 2.0, 3.0 4.25)" and r["b"] == r["c"] == r["t"] and r["r"] == r["c"][::-1]
    assert json.loads(r["j"]) == {"type": "MultiPoint", "coordinates": [[1.5, 2.0], [3.0, 4.25]]} and r["m"] == "MULTILINESTRING ((1.5 2.0, 3.0 4.25))" and json.loads(r["n"])["coordinates"] == [[[1.5, 2.0], [3.0, 4.25]]]
    d = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (0.0, 180.0), (-90.0, 270.0)], "a double, b double").select(geo.heading_difference(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in d] == [20.0, 20.0, 180.0, 0.0]


# import


def test_tags_and_speeds(spark):
    cases = [('"maxspeed"=>"60 mph"', 96.54, 96.54, False), ('"maxspeed"=>"60"', 60, 60, False), ('"maxspeed"=>"60", "maxspeed:forward"=>"30"', 30, 60, False), ('"maxspeed"=>"60mph"', None, None, False), ('"maxspeed"=>"walk", "maxspeed:backward"=>"7"', None, 7, False), ('"oneway"=>"-1"', None, None, False), ('"oneway"=>"true"', None, None, True), ('"junction"=>"roundabout"', None, None, True), ("", None, None, False), (None, None, None, False), ('"a"=>NULL, "oneway"=>"1"', None, None, True)]
    got = osm.road_tags(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, tags string")).orderBy("i").collect()
    for r, (_, f, b, o) in zip(got, cases, strict=True):
        assert (r.maxspeed_forward, r.maxspeed_backward, r.oneway) == (pytest.approx(f) if f else None, pytest.approx(b) if b else None, o)


def test_segments(spark):
    rows = [(1, k, n) for k, n in enumerate([10, 11, 12, 13, 10])] + [(2, 0, 12), (2, 1, 20)] + [(3, 0, 30)]
    located = spark.createDataFrame([(w, s, n, n / 100, 48.0) for w, s, n in rows], "way_id long, sequence_id int, node_id long, lon double, lat double")
    got = {(r.way_id, r.seg, r.source, r.target, len(r.coords)) for r in osm.segments(located).collect()}
    assert got == {(1, 0, 10, 12, 3), (1, 1, 12, 10, 3), (2, 0, 12, 20, 2)}
    assert osm.segments(located.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    path = tmp_path / "types.json"
    path.write_text(src.road_types_json(src.ROAD_TYPES))
    assert {tuple(r) for r in src.road_types(spark, str(path)).collect()} == {tuple(r) for r in src.road_types(spark).collect()}
    base, roads = fixture_map(spark)
    made = []
    for _ in range(2):
        got = src.cached_roads(spark, str(tmp_path / "roads"), lambda: made.append(1) or base)
        assert {r.id for r in got.collect()} == set(range(7))
    assert made == [1] and {r.id for r in src.base_of(roads).collect()} == {0, 2, 4, 6, 8, 10, 12}
    ring = [(10.99, 47.9), (11.015, 47.9), (11.015, 48.1), (10.99, 48.1)]
    assert {r.id for r in src.read_roads(spark, str(tmp_path / "roads"), polygon=ring).collect()} == {0, 3}
    assert src.read_roads(spark, str(tmp_path / "roads"), exclude=[0]).count() == 0
    s = src.Settings.of("matcher.sigma = 5\n# x=1\ntracker.state.ttl=7\nunknown=1")
    assert (s.sigma, s.state_ttl, s.max_radius) == (5.0, 7, 200.0)
    req = [('[{"id":"a","time":1000,"point":"POINT(1 2)"},{"id":"a","time":"1970-01-01 00:00:01+0000","point":"POINT(1 2)","azimuth":370}]',), ('{"format":"slim","request":[{"id":"b","time":5,"point":"POINT(3 4)"}]}',), ("x",), (None,)]
    got = smp.samples_from_requests(spark.createDataFrame(req, "body string"))
    assert {(r.format, r.id, r.time_ms, r.azimuth) for r in got.collect()} == {(None, "a", 1000, None), (None, "a", 1000, 10.0), ("slim", "b", 5, None)}
    assert [tuple(r) for r in smp.duplicate_times(got).collect()] == [("a", 1000, 2)]
    waits = []
    list(smp.replay([{"time_ms": 0}, {"time_ms": 1500}], sleep=waits.append, now=lambda: 0.0))
    assert waits == [1.5]
    with pytest.raises(ValueError):
        list(smp.replay([{"time_ms": 5}, {"time_ms": 1}], sleep=waits.append))
    up = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 2.0, 2.0), ("b", 1, 1.0, 1.0), ("b", 2, None, None), (None, 1, 1.0, 1.0)], "id string, time_ms long, lon double, lat double")
    assert [tuple(r) for r in smp.last_values(up).collect()] == [("a", 2, 2.0, 2.0)]


# fixture map


def fixture_map(spark):
    """Seven roads round (11, 48), three of them one-way."""
    e = [(0, 0, 1, False, "11.000 48.000, 11.010 48.000"), (1, 1, 2, False, "11.010 48.000, 11.020 48.000"), (2, 2, 3, False, "11.020 48.000, 11.030 48.000"), (3, 1, 4, True, "11.010 48.000, 11.011 47.999"), (4, 4, 5, True, "11.011 47.999, 11.021 47.999"), (5, 5, 6, True, "11.021 47.999, 11.021 48.010"), (6, 6, 7, False, "11.021 48.010, 11.021 48.020")]
    rows = [(i, a, b, i, o, 0, 1.0, 100.0, 100.0, g.Line(*zip(*_line(w), strict=True)).length, [{"lon": x, "lat": y} for x, y in _line(w)]) for i, a, b, o, w in e]
    base = spark.createDataFrame(rows, src.BASE_ROAD)
    return base, roadmap.split_roads(base)


@pytest.mark.parametrize(
    "lon, lat, radius, want",
    [(11.001, 48.001, 100, set()), (11.001, 48.001, 200, {0, 1}), (11.010, 48.000, 200, {0, 3}), (11.011, 48.001, 200, {0, 2, 3}), (11.011, 48.001, 300, {0, 2, 3, 8}), (11.019, 48.001, 200, {2, 3, 5, 10})],
)
def test_candidates_after_reduction(spark, lon, lat, radius, want):
    base, roads = fixture_map(spark)
    one = spark.createDataFrame([(1, lon, lat)], "key long, lon double, lat double")
    got = matcher.minset(matcher.candidates(one, base, roads, float(radius)), roadmap.successors(roads)).collect()
    assert {r.edge for r in got} == want
    net = routing.network_of(roads, with_coords=True)
    near = matcher.reduce_candidates(net, net.near(lon, lat, radius))
    assert {int(net.ids[c[0]]) for c in near} == want


def trace(spark=None):
    return [(11.001, 48.001), (11.010, 48.000), (11.019, 48.001), (11.021, 48.011)]


def run_trace(net, points, **kw):
    m = matcher.Matcher(net, matcher.Parameters(**kw))
    s = [{"time_ms": 60_000 * i, "lon": x, "lat": y, "azimuth": None} for i, (x, y) in enumerate(points)]
    return m.trace(s, [net.near(x, y, m.p.radius) for x, y in points])


def test_matching(spark):
    base, roads = fixture_map(spark)
    net = routing.network_of(roads, with_coords=True)
    seq = run_trace(net, trace()).sequence()
    assert [s.what[0] for _, s in seq] == [0, 0, 2, 12] or [s.what[0] for _, s in seq][-1] in (10, 12)
    assert abs(sum(s.filtprob for s in run_trace(net, trace()).last()) - 1) < 1e-9
    # a turn that is left out shortens
    back = [(11.004, 48.0), (11.002, 48.0)]
    long_ = run_trace(net, back, shorten=False, radius=50.0).sequence()
    short = run_trace(net, back, shorten=True, radius=50.0).sequence()
    total = lambda q: sum(s.via[0] for _, s in q if s.via)
    assert total(short) <= total(long_)
    # the distributed matcher agrees with the kernel, in whatever order samples come, over the broadcast or the local networks
    rows = [("a", 60_000 * i, x, y, None) for i, (x, y) in enumerate(trace())]
    schema = "id string, time_ms long, lon double, lat double, azimuth double"
    df = spark.createDataFrame([*rows[::-1], ("a", None, 1.0, 1.0, None), (None, 5, 1.0, 1.0, None), rows[0], ("b", 0, 50.0, 50.0, None)], schema)
    keep = routing.BROADCAST_ROADS
    for most in (keep, 3):
        routing.BROADCAST_ROADS = most
        try:
            got = matcher.match(df, base, roads).orderBy("time_ms").collect()
        finally:
            routing.BROADCAST_ROADS = keep
        assert [(r.edge, round(r.frac, 9), round(r.filtprob, 9)) for r in got] == [(s.what[0], round(s.what[1], 9), round(s.filtprob, 9)) for _, s in seq]
    out = matcher.match(df, base, roads)
    assert len(json.loads(matcher.slim_json(out).first()["json"])) == 4 and len(json.loads(matcher.matched_geojson(out).first()["json"])["coordinates"]) == 4
    ways = matcher.osm_ways(out, roads).first()["ways"]
    assert ways[0] == "0:0:1" and len(ways) == len(set(ways))
    assert matcher.match(df.limit(0), base, roads).count() == 0


def test_emission_transition_bound(spark):
    r = spark.createDataFrame([(20.0, 15_999)], "d double, dt long").select(matcher.emission(F.col("d")).alias("e"), matcher.emission(F.col("d"), 10.0, F.lit(350.0), F.lit(10.0)).alias("a"), matcher.transition(F.col("d"), F.col("dt")).alias("t"), matcher.search_bound(F.col("dt")).alias("b"), matcher.transition(F.col("d"), F.col("dt"), 0.1).alias("l")).first()
    e = math.exp(-2) / math.sqrt(2 * math.pi * 100)
    assert r["e"] == pytest.approx(e) and r["a"] == pytest.approx(e * max(0.01, math.exp(-2) / math.sqrt(200 * math.pi))) and r["t"] == pytest.approx(math.exp(-20 / 15.999) / 15.999) and r["b"] == 1500.0 and r["l"] == pytest.approx(math.exp(-2) / 10)
    s = spark.createDataFrame([("a", t, 11.0 + t * 1e-9, 48.0) for t in (0, 500, 1000, 1500, 2500)], "id string, time_ms long, lon double, lat double")
    assert [r.time_ms for r in matcher.thin(s, 0.0, 1000).orderBy("time_ms").collect()] == [0, 1000, 2500]


# network

GRID = [(0, 0, 1, 100), (1, 1, 0, 100), (2, 0, 2, 160), (3, 2, 0, 160), (4, 1, 2, 50), (5, 2, 1, 50), (6, 1, 3, 200), (7, 3, 1, 200), (8, 2, 3, 100), (9, 3, 2, 100), (10, 2, 4, 40), (11, 4, 2, 40), (12, 3, 4, 100), (13, 4, 3, 100), (14, 3, 5, 200), (15, 5, 3, 200), (16, 4, 5, 60), (17, 5, 4, 60)]


def test_routes_on_a_grid(spark):
    net = Network(*map(list, zip(*GRID, strict=True)), [e[3] for e in GRID])
    got = net.many([(0, 0.3), (1, 0.7)], [(14, 0.3), (15, 0.7)])
    assert [r[3] for r in got] == [[0, 4, 8, 14], [0, 4, 10, 16, 15]] and [r[1] for r in got] == [pytest.approx(280), pytest.approx(360)]
    assert net.routes(0, 0.3, [(14, 0.1)], 200.0) == [None]
    assert net.routes(0, 0.3, [(0, 0.7)])[0][2] == [0] and net.routes(0, 0.7, [(0, 0.3)])[0][2] == [0, 1, 0]
    # all pairs against Floyd-Warshall
    inf = float("inf")
    d = [[0 if i == j else inf for j in range(6)] for i in range(6)]
    for _, a, b, w in GRID:
        d[a][b] = min(d[a][b], w)
    for k, i, j in itertools.product(range(6), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    for (i, _, h, w), (j, t, _, v) in itertools.product(GRID, repeat=2):
        want = w * 0.5 + d[h][t] + v * 0.25 if i != j else w * 0.5 + d[h][t] + v * 0.25
        assert net.routes(i, 0.5, [(j, 0.25)])[0][0] == pytest.approx(want)
    at = lambda e, f: {"edge": e, "frac": f}
    req = spark.createDataFrame([("k", [at(0, 0.3), at(1, 0.7), at(77, 0.0)], [at(14, 0.3), at(15, 0.7)], None), ("b", [at(0, 0.3)], [at(14, 0.1)], 200.0), ("n", None, None, None)], "key string, sources array<struct<edge: long, frac: double>>, targets array<struct<edge: long, frac: double>>, bound double")
    rows = {(r.key, r.target_no, r.source_no, tuple(r.edges)) for r in routing.routes(req, net).collect()}
    assert rows == {("k", 0, 0, (0, 4, 8, 14)), ("k", 1, 0, (0, 4, 10, 16, 15))}


def test_paths(spark):
    edges = spark.createDataFrame(GRID, "id long, source long, target long, length long")
    p = spark.createDataFrame([(1, [0, 4, 8], 0.5, 0.25), (2, [0, 8], 0.0, 1.0), (3, [0], 0.7, 0.3), (4, [0], 0.3, 0.7), (5, [99], 0.0, 1.0), (6, [], 0.0, 1.0)], "path_id long, edges array<long>, source_frac double, target_frac double")
    assert {r.path_id: r.valid for r in roadmap.path_valid(p, edges).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert {r.path_id: r.cost for r in roadmap.path_costs(p, edges, F.col("length").cast("double")).collect()} == {1: 50 + 50 + 25, 2: 200, 3: pytest.approx(-40), 4: pytest.approx(40), 5: None}
    l = spark.createDataFrame([(1, [0], 0.5, 1.0), (2, [0], 0.5, 0.6), (3, [0], 0.5, 0.6)], "path_id long, edges array<long>, source_frac double, target_frac double")
    r = spark.createDataFrame([(1, [4, 8], 0.0, 0.5), (2, [0, 4], 0.6, 0.5), (3, [4], 0.0, 1.0)], "path_id long, edges array<long>, source_frac double, target_frac double")
    assert {(x.path_id, tuple(x.edges), x.target_frac, x.ok) for x in roadmap.path_concat(l, r, edges).collect()} == {(1, (0, 4, 8), 0.5, True), (2, (0, 4), 0.5, True), (3, (0,), 0.6, False)}


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 120, (70, 2)))] + [(1000 + k, 1000 + k, 1001 + k) for k in range(40)] + [(5000, 7, 7)]
    label = {}

    def root(v):
        while label.setdefault(v, v) != v:
            v = label[v]
        return v

    for _, a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    got = roadmap.components(spark.createDataFrame([*edges, (9999, None, 3)], "id long, source long, target long")).collect()
    assert {(r.id, r.component) for r in got} == {(i, root(a)) for i, a, _ in edges}


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(7)
    t = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(179.9, 180.1, 80), rng.uniform(9.9, 10.1, 80), strict=True))]
    q = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(179.8, 180.2, 30), rng.uniform(9.8, 10.2, 30), strict=True))]
    from wayline.functions.motion import metres

    d = metres(np.array([p[1] for p in q])[:, None], np.array([p[2] for p in q])[:, None], np.array([p[1] for p in t])[None], np.array([p[2] for p in t])[None])
    fold = lambda rows: [(k, (x + 180) % 360 - 180, y) for k, x, y in rows]
    a, b = spark.createDataFrame([*fold(q), (99, None, 1.0)], "key long, lon double, lat double"), spark.createDataFrame(fold(t), "key long, lon double, lat double")
    assert {(r.key, r.target) for r in search.within(a, b, 5000.0).collect()} == set(map(tuple, np.argwhere(d < 5000).tolist()))
    near = search.nearest(a, b, 3, ties=False).collect()
    assert {(r.key, r.target) for r in near} == {(i, int(j)) for i in range(30) for j in np.argsort(d[i], kind="stable")[:3]}
    assert search.nearest(a, b.limit(2), 3).count() == 60  # fewer than three: all


# filter


def test_filter_step():
    before = [State(("p",), 0.4, math.log10(0.4)), State(("q",), 0.6, math.log10(0.6))]
    now, ways = [(("a",), 0.6), (("b",), 1.0), (("c",), 0.4)], {(0, 0): (0.5, None), (1, 0): (0.2, None), (1, 1): (0.3, ("x",)), (0, 2): (0.0, None)}
    out = step(before, now, ways)
    raw = {"a": 0.6 * (0.5 * 0.4 + 0.2 * 0.6), "b": 1.0 * 0.3 * 0.6}
    assert [s.what[0] for s in out] == ["a", "b"] and all(s.filtprob == pytest.approx(raw[s.what[0]] / sum(raw.values())) for s in out)
    assert out[0].pred is before[0] and out[0].seqprob == pytest.approx(math.log10(0.4 * 0.5 * 0.6)) and out[1].via == ("x",)
    broken = step(before, now, {})
    assert len(broken) == 3 and all(s.pred is None for s in broken) and broken[1].seqprob == 0.0
    assert step([], [(("z",), 0.0)], {}) == []


@pytest.mark.parametrize("k, t", [(-1, -1), (1, -1), (2, -1), (-1, 3000)])
def test_memory(k, t):
    rng = np.random.default_rng(8)
    m, whole = Memory(k, t), []
    for i in range(12):
        e = rng.uniform(0.1, 1, 3)
        ways = {} if i == 6 else {(a, b): (rng.uniform(0.1, 1), None) for a in range(len(m.last())) for b in range(3)}
        m.update(step(m.last(), [((i, b), float(e[b])) for b in range(3)], ways), {"time_ms": 1000 * i})
        whole.append(1)
        assert k < 0 or len(m.vectors) <= k + 1
        assert t < 0 or m.time() - m.vectors[0][0]["time_ms"] <= t
        seq = m.sequence()
        assert [s["time_ms"] for s, _ in seq] == [v[0]["time_ms"] for v in m.vectors] and seq[-1][1] is m.estimate()
        again = Memory.from_json(m.to_json())
        assert [s.what for _, s in again.sequence()] == [s.what for _, s in seq] and again.size() == m.size()
        m = again
    # older vectors hold only candidates that something follows from
    for (_, v), (_, w) in itertools.pairwise(m.vectors):
        assert {id(s) for s in v} == {id(s.pred) for s in w}
    with pytest.raises(ValueError):
        m.update([State(("x",), 1.0, 0.0)], {"time_ms": 0})


# evaluation


def test_evaluation(spark):
    pairs, total = evaluation.align([1, 2, 3, 4], [2, 9, 4], {1: 5.0, 2: 10.0, 3: 1.0, 4: 2.0, 9: 3.0})
    assert pairs == [(1, 0), (3, 2)] and total == 12.0
    left = spark.createDataFrame([("a", i, e) for i, e in enumerate([1, 2, 3, 4])], "id string, pos int, edge long")
    right = spark.createDataFrame([("a", i, e) for i, e in enumerate([2, 9, 4])] + [("b", 0, 1)], "id string, pos int, edge long")
    edges = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 1.0), (4, 2.0), (9, 3.0)], "id long, length double")
    got = {r.id: (r.matched, r.error) for r in evaluation.route_mismatch(left, right, edges).collect()}
    assert got["a"] == (12.0, pytest.approx((18 + 15 - 24) / 18)) and got["b"][1] is None
    s = spark.createDataFrame([("a", t * 1000) for t in (0, 5, 10, 14, 20, 23)], "id string, time_ms long")
    assert [r.time_ms for r in evaluation.subsample(s, 10).orderBy("time_ms").collect()] == [0, 10_000, 20_000, 23_000]
    m = spark.createDataFrame([("a", t, e) for t, e in enumerate([1, 1, 2, 2, 1])], "id string, time_ms long, edge long")
    assert [r.edge for r in evaluation.edge_sequence(m).orderBy("pos").collect()] == [1, 2, 1]


# clustering


def groups(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], []).append(tuple(round(r[c], 6) for c in cols))
    return {tuple(sorted(v)) for v in out.values()}


def test_line_clusters(spark):
    v = [0.0, 3.0, 6.0, 6.5, 8.0, 11.0, 13.5, 15.5, 18.0, 20.5, 23.0, 24.0, 24.5, 25.0, 28.0]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "x double")
    one = lambda *xs: tuple((x,) for x in xs)
    assert groups(cluster.cluster_line(df, 2.0, 2), "x") == {one(23.0, 24.0, 24.5, 25.0), one(6.0, 6.5, 8.0), one(13.5, 15.5)}
    assert groups(cluster.cluster_line(df, 3.0, 2), "x") == {one(*v)}
    assert cluster.cluster_line(df.limit(0), 2.0, 2).count() == 0
    rng = np.random.default_rng(9)
    x = np.round(rng.uniform(0, 40, 300), 2)
    near = np.abs(x[:, None] - x[None]) <= 0.15 + 1e-9
    core = near.sum(axis=1) >= 5
    got = {r.x: r.cluster for r in cluster.cluster_line(spark.createDataFrame([(float(k),) for k in x], "x double"), 0.15 + 1e-9, 5).collect()}
    assert set(got) == {float(k) for k, c in zip(x, (near & core[None]).any(axis=1), strict=True) if c}
    for i, j in np.argwhere(near & core[:, None] & core[None]):
        assert got[float(x[i])] == got[float(x[j])]


def test_ring_clusters_and_density(spark):
    make = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    c = cluster.cluster_ring(make([0.05, 2.35, 2.3, 1.0]), 2.4, 0.1, 2)
    assert groups(c, "x") == {((0.05,), (2.3,), (2.35,))}
    b = cluster.ring_bounds(c, 2.4, 0.1).first()
    assert (b["low"], b["high"]) == (pytest.approx(2.3), pytest.approx(0.05))
    # Steps of the density of two lists on a ring of 2.4
    cases = [
        ([-1.9, -1.75, -1.7, 0.7, 0.9, 2.8, 3.1, 3.15, 3.2, 5.4, 5.5, 5.8], [(0.0, 0), (0.4, 2), (0.5, 4), (0.6, 8), (0.8, 4), (0.9, 2), (1.0, 0)]),
        ([-1.9, -1.7, -1.4, -1.25, -1.2, 0.05, 0.7, 0.75, 0.9, 1.2, 1.3, 1.7, 2.0, 2.3, 2.35, 2.8, 3.1, 3.15, 3.2, 3.5, 3.55, 3.6, 5.4, 5.5, 6.0],
         [(0.0, 2), (0.05, 0), (0.4, 2), (0.5, 4), (0.6, 8), (0.9, 2), (1.0, 8), (1.3, 0), (1.7, 1), (1.7, 0), (2.0, 1), (2.0, 0), (2.3, 2)]),
    ]
    for values, want in cases:
        got = sorted((round(r.x, 6), r.density) for r in cluster.ring_density(make(values), 2.4, 0.1).collect())
        assert got == sorted(want)
    assert [tuple(r) for r in cluster.ring_density(make([]), 2.4, 0.1).collect()] == [(0.0, 0)]


def test_point_clusters(spark):
    p = [(11.560385, 48.176874), (11.560551, 48.177206), (11.557062, 48.176892), (11.557182, 48.177492)]
    df = spark.createDataFrame([*p, p[0], (None, 1.0)], "lon double, lat double")
    assert groups(cluster.cluster_points(df, 75.0, 2), "lon", "lat") == {tuple(sorted(p[:2])), tuple(sorted(p[2:]))}
    assert groups(cluster.cluster_points(df, 50.0, 2), "lon", "lat") == {tuple(sorted(p[:2]))}
    assert cluster.cluster_points(df.limit(0), 50.0, 2).count() == 0


# tracking


def test_online_equals_offline(spark, tmp_path):
    base, roads = fixture_map(spark)
    net = routing.network_of(roads, with_coords=True)
    pts = trace()
    rows = [("a", 60_000 * i, x, y, None) for i, (x, y) in enumerate(pts)]
    late, quick = ("a", 1000, 11.0, 48.0, None), ("a", 60_000 * 3 + 500, 11.021, 48.0111, None)
    for i, r in enumerate([*rows, late, quick]):
        spark.createDataFrame([r], smp.SAMPLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(0.02)
    stream = smp.replay_stream(spark, str(tmp_path / "in"))
    settings = tracker.TrackerSettings(ttl_s=None, least_ms=1000, k=-1)
    q = tracker.track(stream, net, settings=settings).writeStream.format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.sql("select * from updates").collect()
    whole = run_trace(net, pts)
    assert [r.edge for r in got if r.kind == "update"][-1] == whole.estimate().what[0]
    assert [round(r.prob, 9) for r in got if r.kind == "update"][-1] == round(whole.estimate().filtprob, 9)
    assert [r.kind for r in got].count("update") == 4 and [r.time_ms for r in got if r.kind == "late"] == [1000]


def test_tracker_rules():
    net = Network([0, 1], [0, 1], [1, 0], [1000.0, 1000.0], [36.0, 36.0], [[(11.0, 48.0), (11.0134, 48.0)], [(11.0134, 48.0), (11.0, 48.0)]])
    t = tracker.Tracker(net, matcher.Parameters(radius=50.0), tracker.TrackerSettings(least_ms=1000, least_m=2.0, sensitive_m=20.0))
    m = Memory(0, -1)
    s = lambda ms, lon: {"time_ms": ms, "lon": lon, "lat": 48.0, "azimuth": 90.0}
    a, first = t.update(m, None, s(0, 11.001))
    assert a == "update" and first["edge"] == 0
    assert t.update(m, first, s(500, 11.002))[0] == "thinned" and t.update(m, first, s(2000, 11.00101))[0] == "thinned"
    assert t.update(m, first, s(3000, 11.0011))[0] == "quiet" and t.update(m, first, s(2500, 11.0011))[0] == "late"
    assert t.update(m, first, s(9000, 12.0))[0] == "lost" and t.update(m, first, s(10_000, 11.003))[0] == "update"


def test_route_geometry():
    net = Network([0, 2], [0, 1], [1, 2], [1.0, 1.0], [1.0, 1.0], [[(11.0, 48.0), (11.01, 48.0)], [(11.01, 48.0), (11.01, 48.01)]])
    got = route_geometry(net, [0, 1], 0.5, 0.5)
    assert len(got) == 3 and got[1] == pytest.approx((11.01, 48.0)) and got[0][0] == pytest.approx(11.005) and got[2][1] == pytest.approx(48.005, abs=1e-6)


def test_batch_twins(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "a", 10), (4, "b", 1)], "no int, id string, time_ms long")
    assert {r.no: r.late for r in tracker.late_flags(df, "no").collect()} == {1: False, 2: True, 3: False, 4: False}
    s = spark.createDataFrame([("a", 10, 1.0, 1.0), ("b", 99, 1.0, 1.0)], "id string, time_ms long, lon double, lat double")
    assert [r.id for r in tracker.latest_state(s, 50, 100).collect()] == ["b"]


def test_filter_step_as_joins(spark):
    from wayline.operators.filtering import filter_step

    before = [(1, 0, 0.4, math.log10(0.4)), (1, 1, 0.6, math.log10(0.6)), (2, 0, 1.0, 0.0)]
    now = [(1, 0, 0.6), (1, 1, 1.0), (1, 2, 0.4), (2, 0, 0.3), (2, 1, 0.7), (3, 0, 0.5), (3, 1, 0.0)]
    ways = [(1, 0, 0, 0.5), (1, 1, 0, 0.2), (1, 1, 1, 0.3), (1, 0, 2, 0.0), (2, 0, 0, None)]
    got = filter_step(spark.createDataFrame(before, "key long, i int, filtprob double, seqprob double"), spark.createDataFrame(now, "key long, j int, emission double"), spark.createDataFrame(ways, "key long, i int, j int, p double"))
    rows = {(r.key, r.j): (r.filtprob, r.seqprob, r.pred, r.fresh) for r in got.collect()}
    kernel = step([State((0,), 0.4, math.log10(0.4)), State((1,), 0.6, math.log10(0.6))], [((0,), 0.6), ((1,), 1.0), ((2,), 0.4)], {(0, 0): (0.5, None), (1, 0): (0.2, None), (1, 1): (0.3, None)})
    for s in kernel:
        f, q, p, fresh = rows[1, s.what[0]]
        assert f == pytest.approx(s.filtprob) and q == pytest.approx(s.seqprob) and p == s.pred.what[0] and not fresh
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)}
    assert rows[2, 1] == (pytest.approx(0.7), pytest.approx(math.log10(0.7)), None, True) and rows[3, 0][0] == 1.0


def test_forms(spark):
    m = spark.createDataFrame([("a", 0, 5, 0, 0.5, 11.0, 48.0, 0.9, -1.0, None, None), ("a", 0, 9, 2, 0.5, 11.1, 48.0, 0.8, -2.0, 12.0, [0, 2])], matcher.MATCHED)
    _, roads = fixture_map(spark)
    get = lambda kind: json.loads(matcher.formatted(m, roads, kind).first()["json"])
    assert get("slim") == [{"road": 0, "frac": 0.5, "time": 5}, {"road": 2, "frac": 0.5, "time": 9}]
    assert get("geojson")["type"] == "MultiPoint" and get("debug")[1]["route"] == [0, 2] and get("osm") == ["0:0:1", "1:1:2"]
    with pytest.raises(ValueError):
        matcher.formatted(m, roads, "xml")
    u = spark.createDataFrame([("a", 1, '[{"edge":1,"frac":0.5,"prob":0.995},{"edge":2,"frac":0.5,"prob":0.005}]')], "id string, time_ms long, candidates string")
    r = tracker.visible_candidates(u).collect()
    assert [(x.edge, round(x.opacity, 6)) for x in r] == [(1, round(math.log10(9 * 0.995 + 1), 6))]


def test_registered_matching_uses_the_defaults(spark, monkeypatch):
    from wayline.plans import map_queries

    base, roads = fixture_map(spark)
    monkeypatch.setattr(map_queries, "_base", lambda s, d: base)
    monkeypatch.setattr(map_queries, "_places", lambda s, d: s.createDataFrame([(1, 11.001, 48.001)], "key long, lon double, lat double"))  # 111 m from a road
    rows = [("a", 60_000 * i, x, y, None) for i, (x, y) in enumerate(trace())]
    monkeypatch.setattr(map_queries, "_traces", lambda s, d: s.createDataFrame(rows, "id string, time_ms long, lon double, lat double, azimuth double"))
    assert {r.edge for r in map_queries.mm_candidates(spark, "").collect()} == {0, 1} == {r.edge for r in map_queries.mm_minset(spark, "").collect()}
    assert map_queries.mm_match(spark, "").count() == 4


def test_filter_of_vanishing_probabilities():
    # two far candidates reached over very unlikely ways: their products are below the least double, their ratio is not
    out = step([State((0,), 1.0, 0.0)], [((1,), 1e-200), ((2,), 3e-200)], {(0, 0): (1e-200, None), (0, 1): (1e-200, None)})
    assert [s.filtprob for s in out] == pytest.approx([0.25, 0.75]) and all(s.pred is not None for s in out)


def test_filter_steps_of_whole_ways(spark, monkeypatch):
    from wayline.plans import map_queries

    nodes = {1: [3, 4, 17, 6, 7, 34, 51, 9], 2: [8], 3: [2, 5, 5, 18]}
    rows = [(w, i, n) for w, v in nodes.items() for i, n in enumerate(v)]
    monkeypatch.setattr(map_queries, "table", lambda s, d, t: s.createDataFrame(rows, "way_id long, sequence_id int, node_id long"))
    want, e = {}, lambda n, j: (0.7, 0.3)[j] if n % 2 else (0.2, 0.8)[j]
    for w, v in nodes.items():
        f, q = [], []
        for k, n in enumerate(v, 1):
            m = [[0.9 if i == j else 0.1 for j in range(2)] for i in range(2)]
            new = k == 1 or n % 17 == 0
            g_ = [e(n, j) * (1 if new else sum(m[i][j] * f[i] for i in range(2))) for j in range(2)]
            r = [math.log10(e(n, j)) + (0 if new else max(q[i] + math.log10(m[i][j]) for i in range(2))) for j in range(2)]
            f, q = [x / sum(g_) for x in g_], r
            want |= {(w, k, j): (f[j], q[j], new) for j in range(2) if k > 1}
    got = [*map_queries.QUERIES["hmm_step_all"](spark, "").collect(), *map_queries.QUERIES["hmm_break_all"](spark, "").collect()]
    assert len(got) == len(want) == 20 and sum(r.fresh for r in got) == 6
    for r in got:
        f, q, new = want[r.key, r.k, r.j]
        assert abs(r.filtprob - f * 1e9) < 2 and abs(r.seqprob - q * 1e9) < 2 and r.fresh == new and (r.pred == -1) == new


def test_pairs_hold_long_segments(spark, monkeypatch):
    from wayline.plans import map_queries

    ends = [((11.0, 48.0), (11.01, 48.01)), ((11.0, 48.0), (13.0, 49.0)), ((179.9, 10.0), (-179.9, 10.1)), ((5.0, 5.0), (5.0, 5.0)), ((0.0, 10.0), (179.99, -10.0))]
    rows = [(i, 10 + i, 20 + i, i, False, 0, 1.0, 100.0, 100.0, 1.0, [{"lon": x, "lat": y} for x, y in p]) for i, p in enumerate(ends)]
    nodes = [(10 + i, *p[0]) for i, p in enumerate(ends)]
    monkeypatch.setattr(map_queries, "_base", lambda s, d: s.createDataFrame(rows, src.BASE_ROAD))
    monkeypatch.setattr(map_queries, "table", lambda s, d, t: None)
    monkeypatch.setattr(map_queries, "current_nodes", lambda t: spark.createDataFrame(nodes, "key long, lon double, lat double"))
    got = {q: {r.road: r for r in map_queries.QUERIES[q](spark, "").collect()} for q in ("geo_intercept", "geo_interpolate", "geo_azimuth", "geo_intersect")}
    assert all(set(v) == {0, 1, 2} for v in got.values())
    for i in (0, 1, 2):
        (ax, ay), (bx, by) = ends[i]
        p = got["geo_interpolate"][i]
        assert float(g.distance(ax, ay, p.lon, p.lat)) == pytest.approx(float(g.distance(ax, ay, bx, by)) / 4) and abs(got["geo_intercept"][i].frac) < 1e-6
        x = got["geo_intersect"][i]
        for a, b in (((ax, ay), (bx, by)), ((ax, by), (bx, ay))):  # the crossing lies on both diagonals
            assert abs(float(g.distance(*a, x.lon, x.lat)) + float(g.distance(x.lon, x.lat, *b)) - float(g.distance(*a, *b))) < 1e-3
    assert got["geo_azimuth"][2].azimuth == pytest.approx(63.2, abs=0.1)  # east over the 180th meridian


def test_local_network_holds_long_candidates(spark, monkeypatch):
    ends = [((11.0, 48.0), (11.6, 48.0)), ((11.6, 48.0), (11.61, 48.0)), ((12.5, 48.0), (12.51, 48.0))]
    rows = [(i, 2 * i if i == 2 else i, 2 * i + 1 if i == 2 else i + 1, i, False, 0, 1.0, 100.0, 100.0, float(g.distance(*p[0], *p[1])), [{"lon": x, "lat": y} for x, y in p]) for i, p in enumerate(ends)]
    base = spark.createDataFrame(rows, src.BASE_ROAD)
    roads = roadmap.split_roads(base)
    df = spark.createDataFrame([("a", 60_000 * i, 11.3 + 0.001 * i, 48.0006, None) for i in range(3)], "id string, time_ms long, lon double, lat double, azimuth double")
    p = matcher.Parameters(distance=3000.0)
    found = lambda: [(r.edge, round(r.frac, 9), round(r.filtprob, 9), r.route) for r in matcher.match(df, base, roads, p).orderBy("time_ms").collect()]
    whole = found()
    monkeypatch.setattr(routing, "BROADCAST_ROADS", 3)
    assert len(whole) == 3 and found() == whole


def test_feet_in_the_plane_and_on_the_ellipsoid():
    rng = np.random.default_rng(6)
    n = 400
    cx, cy = rng.uniform(-180, 180, n), rng.uniform(-75, 75, n)
    off = lambda: g.direct(cx, cy, rng.uniform(0, 360, n), rng.uniform(0, 2900, n))[:2]
    (ax, ay), (bx, by) = off(), off()
    f, x, y, d, turn = g.feet(ax, ay, bx, by, cx, cy)
    want = np.clip(g.intercept(ax, ay, bx, by, cx, cy), 0, 1)
    wx, wy = g.interpolate(ax, ay, bx, by, want)
    assert np.abs(d - g.distance(wx, wy, cx, cy)).max() < 1e-3
    assert (g.distance(x, y, wx, wy) < 0.02).all()
    bend = np.abs((turn - g.azimuth(ax, ay, bx, by, want) + 180) % 360 - 180)
    assert bend[g.distance(ax, ay, bx, by) > 1].max() < 1e-3


def test_routes_do_not_depend_on_the_size_of_the_map(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 40
    ends = rng.integers(0, 25, (n, 2))
    edges = spark.createDataFrame([(i, int(a), int(b), float(rng.integers(1, 9) * 50), 50.0, 1.0) for i, (a, b) in enumerate(ends)], "id long, source long, target long, length double, maxspeed double, priority double")
    point = lambda: {"edge": int(rng.integers(0, n + 2)), "frac": float(rng.integers(0, 5) / 4)}
    rows = [(k, [point() for _ in range(2)], [point() for _ in range(4)], [None, 300.0, 800.0, 0.0][k % 4]) for k in range(120)]
    asked = spark.createDataFrame(rows, "key long, sources array<struct<edge:long,frac:double>>, targets array<struct<edge:long,frac:double>>, bound double")
    rounded = lambda df: sorted((r.key, r.target_no, r.source_no, round(r.cost, 6), round(r.length, 6), tuple(r.edges)) for r in df.collect())
    small = rounded(routing.shortest_routes(asked, edges))
    monkeypatch.setattr(routing, "BROADCAST_ROADS", 0)
    assert rounded(routing.shortest_routes(asked, edges)) == small and len(small) > 40
    assert routing.shortest_routes(asked.limit(0), edges).count() == 0


def crowded_map(spark):
    """Roads of one to three segments between random nodes, some one-way, some closed, one from far away."""
    rng = np.random.default_rng(11)
    at = [(11 + float(x), 48 + float(y)) for x, y in rng.uniform(0, 0.008, (40, 2))] + [(60.0, 10.0)]
    rows = []
    for i in range(120):
        n = [int(v) for v in rng.integers(0, 40, int(rng.integers(2, 5)))]
        n = [40, *n] if i == 5 else [*n, n[0]] if i % 10 == 0 else n
        line = g.Line(*zip(*(at[v] for v in n), strict=True))
        rows.append((i, n[0], n[-1], i, bool(i % 3 == 0), 0, 1.0, 50.0, 50.0, line.length, [{"lon": at[v][0], "lat": at[v][1]} for v in n]))
    base = spark.createDataFrame(rows, src.BASE_ROAD)
    points = spark.createDataFrame([(k, 11 + float(x), 48 + float(y)) for k, (x, y) in enumerate(rng.uniform(0, 0.008, (60, 2)))], "key long, lon double, lat double")
    return base, roadmap.split_roads(base), points


def test_road_points_are_lifted_where_they_are_found(spark):
    base, roads, points = crowded_map(spark)
    got = matcher.candidates(points, base, roads, 200.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not plan[: plan.index("FlatMapCoGroups")].count("Join")  # no hit is shuffled to its road
    rounded = lambda df: sorted((r.key, r.edge, round(r.frac, 7), round(r.distance, 4), round(r.lon, 8), round(r.lat, 8), round(r.azimuth, 3)) for r in df.collect())
    rows = rounded(got)
    assert rows == rounded(search.road_points(search.roads_within(points, base, 200.0), roads)) and len(rows) > 1000
    # brute force on the ellipsoid, over whole segments
    lines = [(r.id, g.Line([c.lon for c in r.coords], [c.lat for c in r.coords])) for r in base.collect()]
    want = {(p.key, i): v for p in points.collect() for i, line in lines if (v := line.intercept(p.lon, p.lat))[1] < 200}
    have = {(k, e // 2): d for k, e, f, d, *_ in rows if e % 2 == 0}
    assert set(have) == set(want) and all(abs(have[k] - want[k][1]) < 1e-3 for k in want)


def test_the_first_of_equally_near_places_on_a_road_counts(spark):
    # a closed road, nearest at its joint: always at 0, whatever the last digits are
    corner = [(11.0, 48.0), (11.002, 48.0007), (11.0013, 48.003), (11.0, 48.0)]
    base = spark.createDataFrame([(0, 1, 1, 0, True, 0, 1.0, 50.0, 50.0, 1000.0, [{"lon": x, "lat": y} for x, y in corner])], src.BASE_ROAD)
    points = spark.createDataFrame([(k, 11 - 0.00001 * (k % 20 + 1), 48 - 0.00001 * (k // 20 + 1)) for k in range(200)], "key long, lon double, lat double")
    assert {r.frac for r in search.roads_within(points, base, 200.0).collect()} == {0.0}


def test_candidates_are_reduced_where_they_are_found(spark):
    base, roads, points = crowded_map(spark)
    rounded = lambda df: sorted((r.key, r.edge, round(r.frac, 9)) for r in df.collect())
    every = matcher.candidates(points, base, roads, 200.0)
    want = rounded(matcher.minset(every, roadmap.successors(roads)))
    assert rounded(matcher.least_candidates(points, base, roads, 200.0)) == want and 100 < len(want) < every.count()


def test_costs_of_many_points_at_once():
    rng = np.random.default_rng(4)
    ends = rng.integers(0, 12, (30, 2))
    ids = np.r_[0:30, 0:30] * 2 + np.repeat([0, 1], 30)
    length = np.tile(rng.integers(0, 9, 30) * 50.0, 2)
    net = Network(ids, np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]], length, length / 10)
    points = [(int(e), float(f)) for e, f in zip(rng.integers(0, 60, 40), rng.integers(0, 5, 40) / 4, strict=True)]
    near = list({e: (e, f) for e, f in points}.values())
    edges, fracs, targets = np.array([e for e, _ in points]), np.array([f for _, f in points]), Targets(net, near)
    for bound in (float("inf"), 600.0, 0.0):
        cost, second = net.cost_table(edges, fracs, targets, bound)
        for i, (e, f) in enumerate(points):
            c, _, s = net.costs(e, f, targets, bound)
            assert np.array_equal(cost[i], c) and np.array_equal(second[i][np.isfinite(c)], s[np.isfinite(c)])
        # without turns: as the routes themselves are shortened
        m = matcher.Matcher(net, matcher.Parameters())
        short = m._short_costs(edges, fracs, targets, bound)
        for i, a in enumerate(points):
            for j, b in enumerate(near):
                r = net.routes(*a, [b], bound)[0]
                assert short[i, j] == pytest.approx(m._shortened(a, b, r)[0] if r is not None else np.inf, abs=1e-9)


def test_requests_spread_over_the_cores(spark):
    edges = spark.createDataFrame([(i, i, i + 1, 100.0, 50.0, 1.0) for i in range(50)], "id long, source long, target long, length double, maxspeed double, priority double")
    rows = [(k, [{"edge": k, "frac": 0.0}], [{"edge": 49, "frac": 1.0}], None) for k in range(50)]
    asked = spark.createDataFrame(rows, "key long, sources array<struct<edge:long,frac:double>>, targets array<struct<edge:long,frac:double>>, bound double").coalesce(1)
    got = routing.shortest_routes(asked, edges).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.key, len(r.edges)) for r in got} == {(k, 50 - k) for k in range(50)} and len({r.task for r in got}) >= 4
