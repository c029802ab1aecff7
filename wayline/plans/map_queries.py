"""Queries of the map, search, matching, clustering and tracking operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from wayline.functions.geometry import haversine, point
from wayline.functions.hmm import Memory, step
from wayline.functions.times import utc_micros
from wayline.operators import cluster, evaluation, filtering, geo, matcher, osm, roadmap, routing, search
from wayline.operators.activity import sessions
from wayline.plans.data_queries import _NUM, current_nodes, table
from wayline.session import cut
from wayline.sources import roads as src
from wayline.sources import samples as smp
from wayline.streaming import tracker

Query = Callable[[SparkSession, str], DataFrame]
#: The operator's own defaults: every road within 200 m is a candidate, and routes go up to 15 km.
PARAMS = matcher.Parameters()
BOX = [(9.3, 51.2), (9.5, 51.2), (9.5, 51.32), (9.3, 51.32)]


def _micro(c) -> F.Column:
    """Doubles as whole millionths, so that both engines agree."""
    return F.round(c * 1e6).cast("long")


def _milli(c):
    return F.round(c * 1e3).cast("long")


def _located(s: SparkSession, d: str) -> DataFrame:
    return osm.located_steps(table(s, d, "way_nodes"), table(s, d, "nodes"))


def _base(s: SparkSession, d: str) -> DataFrame:
    return src.filter_roads(osm.base_roads(table(s, d, "nodes"), table(s, d, "ways"), table(s, d, "way_nodes"), src.road_types(s)), src.road_types(s))


def _roads(s: SparkSession, d: str) -> DataFrame:
    return roadmap.split_roads(_base(s, d))


def _places(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "x0001_015").select(F.col("row_no").alias("key"), point(F.col("geom")).alias("p")).where("p is not null")
    return x.select("key", "p.lon", "p.lat")


def _traces(s: SparkSession, d: str) -> DataFrame:
    """Samples of x0001_015 at their normalised times."""
    from wayline.operators.timestamps import normalise_sequences

    t = normalise_sequences(table(s, d, "x0001_015"), table(s, d, "devices")).select("row_no", F.floor(F.col("utc_us") / 1000).alias("time_ms"))
    x = table(s, d, "x0001_015").select("row_no", "id", point(F.col("geom")).alias("p")).join(t, "row_no").where("p is not null and time_ms is not null")
    return x.select("id", "time_ms", "p.lon", "p.lat", F.lit(None).cast("double").alias("azimuth"))


def _pings(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "samples").select("id", F.floor(utc_micros(table(s, d, "samples"), "time") / 1000).alias("time_ms"), point(F.col("point")).alias("p"), "azimuth", "received", "sample_no")
    return x.where("id is not null and time_ms is not null and p is not null").select("id", "time_ms", "p.lon", "p.lat", smp.normal_azimuth(F.col("azimuth")).alias("azimuth"), "received", "sample_no")


# sources


def src_road_types(s: SparkSession, d: str) -> DataFrame:
    return src.road_types(s)


def src_road_scan_filtered(s: SparkSession, d: str) -> DataFrame:
    base = osm.base_roads(table(s, d, "nodes"), table(s, d, "ways"), table(s, d, "way_nodes"), src.road_types(s))
    x = src.filter_roads(base, src.road_types(s), exclude=[114, 117])
    return x.select("id", "source", "target", "refid", "oneway", F.col("type").cast("int").alias("type"), "priority", _milli(F.col("maxspeed_forward")).alias("forward"), _milli(F.col("maxspeed_backward")).alias("backward"))


def src_samples_json(s: SparkSession, d: str) -> DataFrame:
    return smp.samples_from_json(table(s, d, "tracker_messages")).select("id", "time_ms", "lon", "lat", F.coalesce(_milli(F.col("azimuth")), F.lit(-1)).alias("azimuth_milli"))


def src_duplicate_times(s: SparkSession, d: str) -> DataFrame:
    return smp.duplicate_times(_pings(s, d))


def snk_last_value(s: SparkSession, d: str) -> DataFrame:
    return smp.last_values(_pings(s, d).select("id", "time_ms", "lon", "lat"))


# import


def imp_way_nodes_join(s: SparkSession, d: str) -> DataFrame:
    return _located(s, d)


def imp_node_counts(s: SparkSession, d: str) -> DataFrame:
    return osm.node_counts(_located(s, d))


def imp_way_aggs(s: SparkSession, d: str) -> DataFrame:
    x = osm.way_arrays(_located(s, d))
    join = lambda f: F.concat_ws(",", F.transform("steps", lambda e: e[f].cast("string")))
    return x.select("way_id", join("sequence_id").alias("seqs"), join("node_id").alias("nodes"), join("uses").alias("counts"))


def imp_oneway(s: SparkSession, d: str) -> DataFrame:
    return osm.road_tags(table(s, d, "ways").select("tags").distinct()).select("tags", "oneway")


def imp_maxspeed(s: SparkSession, d: str) -> DataFrame:
    return osm.road_tags(table(s, d, "ways").select("tags").distinct()).select("tags", *(F.coalesce(_milli(F.col(f"maxspeed_{k}")), F.lit(-1)).alias(k) for k in ("forward", "backward")))


def imp_segments(s: SparkSession, d: str) -> DataFrame:
    return osm.segments(_located(s, d)).select("way_id", "seg", "source", "target", F.size("coords").alias("n_points"))


# geometry


def geo_distance(s: SparkSession, d: str) -> DataFrame:
    n = current_nodes(table(s, d, "nodes"))
    return n.select("key", _milli(haversine(F.col("lon"), F.col("lat"), F.lit(11.0), F.lit(48.0))).alias("mm"))


def geo_length(s: SparkSession, d: str) -> DataFrame:
    x = osm.way_arrays(_located(s, d)).where(F.size("steps") > 1)
    return x.select("way_id", F.round(osm.polyline_length(F.transform("steps", lambda e: F.struct(e["lon"].alias("lon"), e["lat"].alias("lat")))) * 100).cast("long").alias("cm"))


def geo_heading_diff(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "samples").select("sample_no", _milli(geo.heading_difference(smp.normal_azimuth(F.col("azimuth")), F.lit(350.0))).alias("milli")).where("milli is not null")


def geo_wkt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "x0001_015").select("row_no", point(F.col("geom")).alias("p")).where("p is not null").select("row_no", _micro(F.col("p.lon")).alias("lon"), _micro(F.col("p.lat")).alias("lat"))


def geo_in_polygon(s: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes")).where(geo.in_polygon(F.col("lon"), F.col("lat"), BOX)).select("key")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Ends of the map's segments, with a node as third point; without those of no length and the nearly antipodal (over 19 900 km)."""
    n = current_nodes(table(s, d, "nodes")).select(F.col("key").alias("source"), F.col("lon").alias("cx"), F.col("lat").alias("cy"))
    seg = search.road_segments(_base(s, d)).where("ax <> bx or ay <> by").where(haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) < 1.99e7)
    return seg.join(_base(s, d).select(F.col("id").alias("road"), "source"), "road").join(n, "source")


def geo_intercept(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("road", "seg", geo.intercept("ax", "ay", "bx", "by", "cx", "cy").alias("frac"))


def geo_interpolate(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("road", "seg", geo.interpolate("ax", "ay", "bx", "by", F.lit(0.25)).alias("p")).select("road", "seg", "p.lon", "p.lat")


def geo_azimuth(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("road", "seg", geo.azimuth("ax", "ay", "bx", "by", F.lit(0.5)).alias("azimuth"))


def geo_envelope(s: SparkSession, d: str) -> DataFrame:
    n = current_nodes(table(s, d, "nodes"))
    e = n.select("key", geo.envelope("lon", "lat", F.lit(100.0)).alias("e"))
    return e.select("key", *(_micro(F.col(f"e.{c}")).alias(c) for c in ("west", "south", "east", "north")))


def geo_reverse(s: SparkSession, d: str) -> DataFrame:
    """Ends of the map's lines turned round, through their binary form."""
    turned = _base(s, d).select("id", geo.from_wkb(geo.to_wkb(geo.reverse_line(F.col("coords")))).alias("c"))
    at = lambda i, k: _micro(F.element_at("c", i)[k])
    return turned.select("id", at(1, "lon").alias("lon1"), at(1, "lat").alias("lat1"), at(-1, "lon").alias("lon2"), at(-1, "lat").alias("lat2"), F.size("c").alias("n"))


def geo_intersect(s: SparkSession, d: str) -> DataFrame:
    x = _pairs(s, d).select("road", "seg", geo.intersect("ax", "ay", "bx", "by", "ax", "by", "bx", "ay").alias("p"))
    return x.select("road", "seg", "p.lon", "p.lat")


# search


def idx_radius(s: SparkSession, d: str) -> DataFrame:
    return search.within(_places(s, d), current_nodes(table(s, d, "nodes")), 30.0).select("key", "target", _milli(F.col("distance")).alias("mm"))


def idx_nearest(s: SparkSession, d: str) -> DataFrame:
    return search.nearest(_places(s, d), current_nodes(table(s, d, "nodes"))).select("key", "target", _milli(F.col("distance")).alias("mm"))


def idx_knearest(s: SparkSession, d: str) -> DataFrame:
    return search.nearest(_places(s, d), current_nodes(table(s, d, "nodes")), 3, ties=False).select("key", "target", "rank")


def idx_roadpoints(s: SparkSession, d: str) -> DataFrame:
    base = cut(_base(s, d))
    return matcher.candidates(_places(s, d), base, roadmap.split_roads(base), PARAMS.radius)


# graph


def map_split(s: SparkSession, d: str) -> DataFrame:
    return _roads(s, d).select("id", "base_id", "heading", "source", "target", F.col("type").cast("int").alias("type"), _milli(F.col("maxspeed")).alias("maxspeed"))


def map_json(s: SparkSession, d: str) -> DataFrame:
    return roadmap.road_json(_roads(s, d))


def graph_successors(s: SparkSession, d: str) -> DataFrame:
    return roadmap.successors(_roads(s, d))


def graph_components(s: SparkSession, d: str) -> DataFrame:
    return roadmap.components(_roads(s, d))


def cost_time_priority(s: SparkSession, d: str) -> DataFrame:
    r = _roads(s, d)
    return r.select("id", _milli(roadmap.cost_time_priority(F.round("length", 2), F.col("maxspeed"), F.col("priority"))).alias("cost_ms"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Every way as a path over its forward roads."""
    e = F.sort_array(F.collect_list(F.col("id") * 2))
    return _base(s, d).groupBy(F.col("refid").alias("path_id")).agg(e.alias("edges")).withColumns({"source_frac": F.lit(0.25), "target_frac": F.lit(0.75)})


def route_cost(s: SparkSession, d: str) -> DataFrame:
    c = roadmap.path_costs(_paths(s, d), _roads(s, d), F.round("length", 2))
    return c.select("path_id", F.round(F.col("cost") * 1e4).cast("long").alias("cost_tenth_mm"), "n_edges")


def path_valid(s: SparkSession, d: str) -> DataFrame:
    return roadmap.path_valid(_paths(s, d), _roads(s, d))


def route_concat(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d).where(F.size("edges") >= 2)
    cutting = lambda e, a, b: p.select("path_id", e.alias("edges"), F.lit(a).alias("source_frac"), F.lit(b).alias("target_frac"))
    left = cutting(F.slice("edges", 1, 1), 0.25, 1.0)
    right = cutting(F.slice("edges", 2, F.size("edges") - 1), 0.0, 0.75)
    x = roadmap.path_concat(left, right, _roads(s, d))
    return x.select("path_id", F.size("edges").alias("n_edges"), "ok", "source_frac", "target_frac")


def _requests(s: SparkSession, d: str, bound: float | None) -> DataFrame:
    """From the first road of every way to its last, and to the roads that leave its end."""
    p = _paths(s, d)
    at = lambda e, f: F.struct(e.alias("edge"), F.lit(f).alias("frac"))
    return p.select(F.col("path_id").alias("key"), F.array(at(F.col("edges")[0], 0.5)).alias("sources"), F.array(at(F.element_at("edges", -1), 0.75), at(F.col("edges")[0], 0.25)).alias("targets"), F.lit(bound).cast("double").alias("bound"))


def route_shortest(s: SparkSession, d: str) -> DataFrame:
    return routing.shortest_routes(_requests(s, d, None), _roads(s, d))


def route_bounded(s: SparkSession, d: str) -> DataFrame:
    return routing.shortest_routes(_requests(s, d, 2000.0), _roads(s, d))


def route_msmt(s: SparkSession, d: str) -> DataFrame:
    r = _requests(s, d, 5000.0)
    return routing.shortest_routes(r.withColumn("sources", F.concat("sources", F.transform("targets", lambda t: F.struct(t["edge"].alias("edge"), F.lit(0.0).alias("frac"))))), _roads(s, d))


# matching


def mm_candidates(s: SparkSession, d: str) -> DataFrame:
    return idx_roadpoints(s, d)


def mm_minset(s: SparkSession, d: str) -> DataFrame:
    base = cut(_base(s, d))
    return matcher.least_candidates(_places(s, d), base, roadmap.split_roads(base), PARAMS.radius)


def mm_emission(s: SparkSession, d: str) -> DataFrame:
    x = search.within(_places(s, d), current_nodes(table(s, d, "nodes")), 30.0)
    return x.select("key", "target", F.round(matcher.emission(F.round("distance", 3)) * 1e9).cast("long").alias("nano"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("time_ms", "sample_no")
    return _pings(s, d).select("id", "sample_no", (F.col("time_ms") - F.lag("time_ms").over(w)).alias("dt")).where("dt is not null")


def mm_bound(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).select("id", "sample_no", matcher.search_bound(F.col("dt")).alias("bound"))


def mm_transition(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).select("id", "sample_no", F.round(matcher.transition(F.lit(10.0), F.col("dt")) * 1e9).cast("long").alias("nano"))


def mm_thin(s: SparkSession, d: str) -> DataFrame:
    return matcher.thin(_pings(s, d), 10.0, 5000)


def mm_match(s: SparkSession, d: str) -> DataFrame:
    """Flagship: the road and the place on it of every sample of every trace."""
    base = cut(_base(s, d))
    return matcher.match(cut(_traces(s, d)), base, cut(roadmap.split_roads(base)), PARAMS)


def mm_slim_json(s: SparkSession, d: str) -> DataFrame:
    return matcher.slim_json(mm_match(s, d))


def mm_geojson(s: SparkSession, d: str) -> DataFrame:
    return matcher.matched_geojson(mm_match(s, d))


def mm_osm_ways(s: SparkSession, d: str) -> DataFrame:
    return matcher.osm_ways(cut(mm_match(s, d)), _roads(s, d))


def _hmm(pdf, k: int = -1, t: int = -1):
    """A toy chain per way: two states whose emissions follow the parity of node ids."""
    import pandas as pd

    m = Memory(k, t)
    for i, node in enumerate(pdf.sort_values("sequence_id")["node_id"]):
        e = [0.7, 0.3] if node % 2 else [0.2, 0.8]
        if node % 17 == 0:
            ways = {}
        else:
            ways = {(a, b): (0.9 if m.last()[a].what[0] == b else 0.1, None) for a in range(len(m.last())) for b in range(2)}
        m.update(step(m.last(), [((b,), e[b]) for b in range(2)], ways), {"time_ms": i * 1000})
    best = m.estimate()
    seq = "".join(str(s.what[0]) for _, s in m.sequence())
    return pd.DataFrame([(pdf["way_id"].iloc[0], best.filtprob, best.seqprob, seq, m.size(), len(m.vectors))], columns=["way_id", "filtprob", "seqprob", "sequence", "n_candidates", "n_vectors"])


_HMM = "way_id long, filtprob double, seqprob double, sequence string, n_candidates int, n_vectors int"


def _vectors(s: SparkSession, d: str):
    """Of every way: the first two nodes as vectors of two states, and the transitions between them (none where the second node divides by 17)."""
    w = Window.partitionBy("way_id").orderBy("sequence_id")
    x = osm.steps(table(s, d, "way_nodes")).withColumn("k", F.row_number().over(w)).where("k <= 2")
    odd = F.pmod("node_id", F.lit(2)) == 1
    states = F.explode(F.array(F.struct(F.lit(0).alias("j"), F.when(odd, 0.7).otherwise(0.2).alias("emission")), F.struct(F.lit(1).alias("j"), F.when(odd, 0.3).otherwise(0.8).alias("emission")))).alias("v")
    v = x.select(F.col("way_id").alias("key"), "k", "node_id", states).select("key", "k", "node_id", "v.j", "v.emission")
    none = s.createDataFrame([], "key long, i int, filtprob double, seqprob double")
    ways = x.where("k = 2 and node_id % 17 <> 0").select(F.col("way_id").alias("key"), F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(0.9 if a == b else 0.1).alias("p")) for a in range(2) for b in range(2)))).alias("t"))
    first = filtering.filter_step(none, v.where("k = 1").select("key", "j", "emission"), s.createDataFrame([], "key long, i int, j int, p double"))
    return first, v.where("k = 2").select("key", "j", "emission"), ways.select("key", "t.i", "t.j", "t.p")


def _nano(df: DataFrame) -> DataFrame:
    n = lambda c: F.round(F.col(c) * 1e9).cast("long").alias(c)
    return df.select("key", "j", n("filtprob"), n("seqprob"), F.coalesce("pred", F.lit(-1)).alias("pred"), "fresh")


def hmm_initial(s: SparkSession, d: str) -> DataFrame:
    return _nano(_vectors(s, d)[0])


def _second(s: SparkSession, d: str) -> DataFrame:
    first, now, ways = _vectors(s, d)
    return _nano(filtering.filter_step(first.select("key", F.col("j").alias("i"), "filtprob", "seqprob"), now, ways))


def hmm_step(s: SparkSession, d: str) -> DataFrame:
    return _second(s, d).where("not fresh")


def hmm_break(s: SparkSession, d: str) -> DataFrame:
    return _second(s, d).where("fresh")


def _chain(pdf):
    """Vectors of one way, all positions: the kernel of the filter over the chain of ``_hmm``."""
    import pandas as pd

    last, rows = [], []
    for k, node in enumerate(pdf.sort_values("sequence_id")["node_id"], 1):
        e = [0.7, 0.3] if node % 2 else [0.2, 0.8]
        ways = {} if node % 17 == 0 else {(a, b): (0.9 if last[a].what[0] == b else 0.1, None) for a in range(len(last)) for b in range(2)}
        last = step(last, [((b,), e[b]) for b in range(2)], ways)
        rows += [(pdf["way_id"].iloc[0], k, node, x.what[0], e[x.what[0]], x.filtprob, x.seqprob) for x in last]
    return pd.DataFrame(rows, columns=["way_id", "k", "node_id", "j", "emission", "filtprob", "seqprob"])


def _all_steps(s: SparkSession, d: str) -> DataFrame:
    """The filter step as joins on every node of every way but its first, before it the kernel's vector of the node before: (key, k, j, ...)."""
    v = cut(osm.steps(table(s, d, "way_nodes")).groupBy("way_id").applyInPandas(_chain, "way_id long, k int, node_id long, j int, emission double, filtprob double, seqprob double"))
    at = lambda k: F.struct(F.col("way_id").alias("way"), k.alias("k")).alias("key")
    before = v.select(at(F.col("k") + 1), F.col("j").alias("i"), "filtprob", "seqprob")
    now = v.where("k > 1").select(at(F.col("k")), "j", "emission")
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(0.9 if a == b else 0.1).alias("p")) for a in range(2) for b in range(2)))).alias("t")
    ways = v.where("k > 1 and j = 0 and node_id % 17 <> 0").select(at(F.col("k")), pairs).select("key", "t.i", "t.j", "t.p")
    x = _nano(filtering.filter_step(before, now, ways))
    return x.select(F.col("key.way").alias("key"), "key.k", "j", "filtprob", "seqprob", "pred", "fresh")


def hmm_step_all(s: SparkSession, d: str) -> DataFrame:
    """``hmm_step`` at every node of a way, k its position; ``hmm_step`` itself is the second node, as its SQL says."""
    return _all_steps(s, d).where("not fresh")


def hmm_break_all(s: SparkSession, d: str) -> DataFrame:
    """``hmm_break`` at every node of a way, k its position; ``hmm_break`` itself is the second node, as its SQL says."""
    return _all_steps(s, d).where("fresh")


def hmm_viterbi(s: SparkSession, d: str) -> DataFrame:
    return osm.steps(table(s, d, "way_nodes")).groupBy("way_id").applyInPandas(lambda p: _hmm(p), _HMM)


def kstate_k(s: SparkSession, d: str) -> DataFrame:
    return osm.steps(table(s, d, "way_nodes")).groupBy("way_id").applyInPandas(lambda p: _hmm(p, k=3), _HMM)


def kstate_t(s: SparkSession, d: str) -> DataFrame:
    return osm.steps(table(s, d, "way_nodes")).groupBy("way_id").applyInPandas(lambda p: _hmm(p, t=4000), _HMM)


# evaluation


def ev_subsample(s: SparkSession, d: str) -> DataFrame:
    return evaluation.subsample(_pings(s, d).select("id", "time_ms").distinct(), 30)


def ev_sequence(s: SparkSession, d: str) -> DataFrame:
    return evaluation.edge_sequence(mm_match(s, d))


def ev_align(s: SparkSession, d: str) -> DataFrame:
    """All samples against every second one."""
    base = cut(_base(s, d))
    roads, traces = cut(roadmap.split_roads(base)), cut(_traces(s, d))
    few = evaluation.subsample(traces, 30)
    seq = lambda t: evaluation.edge_sequence(matcher.match(t, base, roads, PARAMS))
    return evaluation.route_mismatch(seq(traces), seq(few), roads)


# clustering


def _values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("value").alias("x"))


def _clock(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.floor(F.pmod(utc_micros(table(s, d, "events"), "ts"), F.lit(86_400_000_000)) / 1_000_000).cast("double").alias("x"))


def cl_1d(s: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_line(_values(s, d), 0.01, 3)


def cl_cyclic(s: SparkSession, d: str) -> DataFrame:
    """Clusters named by their smallest value."""
    x = cluster.cluster_ring(_clock(s, d), 86400.0, 10.0, 4)
    return x.select("x", "n", F.min("x").over(Window.partitionBy("cluster")).alias("cluster"))


def cl_bounds(s: SparkSession, d: str) -> DataFrame:
    return cluster.ring_bounds(cl_cyclic(s, d), 86400.0, 10.0, 5.0)


def cl_density_function(s: SparkSession, d: str) -> DataFrame:
    return cluster.ring_density(_clock(s, d), 86400.0, 10.0, 5.0)


def cl_dbscan(s: SparkSession, d: str) -> DataFrame:
    """Places with the smallest place of their cluster."""
    x = cluster.cluster_points(current_nodes(table(s, d, "nodes")), 60.0, 4)
    least = x.groupBy("cluster").agg(F.min(F.struct("lon", "lat")).alias("m"))
    return x.join(least, "cluster").select(*(_micro(F.col(a)).alias(b) for a, b in (("lon", "lon"), ("lat", "lat"), ("m.lon", "cluster_lon"), ("m.lat", "cluster_lat"))))


# tracking, as batches


def st_latest_state(s: SparkSession, d: str) -> DataFrame:
    return tracker.latest_state(_pings(s, d).select("id", "time_ms", "lon", "lat"))


def st_late_flags(s: SparkSession, d: str) -> DataFrame:
    return tracker.late_flags(_pings(s, d).select("id", "time_ms", "sample_no"), "sample_no").select("sample_no", "late")


def st_thin(s: SparkSession, d: str) -> DataFrame:
    return matcher.thin(_pings(s, d), 0.0, 60_000)


def st_sessions_by_ttl(s: SparkSession, d: str) -> DataFrame:
    return sessions(table(s, d, "samples"), gap_ms=60_000)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        mm_match, src_road_types, src_road_scan_filtered, src_samples_json, src_duplicate_times, snk_last_value, imp_way_nodes_join, imp_node_counts, imp_way_aggs, imp_oneway, imp_maxspeed, imp_segments,
        geo_distance, geo_length, geo_heading_diff, geo_wkt, geo_in_polygon, geo_intercept, geo_interpolate, geo_azimuth, geo_envelope, geo_intersect, geo_reverse, idx_radius, idx_nearest, idx_knearest,
        idx_roadpoints, map_split, map_json, graph_successors, graph_components, cost_time_priority, route_cost, path_valid, route_concat, route_shortest, route_bounded, route_msmt, mm_candidates, mm_minset,
        mm_emission, mm_bound, mm_transition, mm_thin, mm_slim_json, mm_geojson, mm_osm_ways, hmm_initial, hmm_step, hmm_break, hmm_step_all, hmm_break_all, hmm_viterbi, kstate_k, kstate_t, ev_subsample, ev_sequence, ev_align, cl_1d, cl_cyclic, cl_bounds,
        cl_density_function, cl_dbscan, st_latest_state, st_late_flags, st_thin, st_sessions_by_ttl,
    )
}


def _xy(column: str) -> str:
    r = rf"regexp_extract({column}, '^\s*(?:SRID=\d+;)?(?i:POINT)\s*(?:Z|M|ZM)?\s*\(\s*({_NUM})\s+({_NUM})[^)]*\)\s*$', ['x', 'y'])"
    return f"try_cast({r}.x as double) as x0, try_cast({r}.y as double) as lat0"


_FOLD = "case when x0 >= -180 and x0 < 180 then x0 else ((x0 + 180) % 360 + 360) % 360 - 180 end as lon, lat0 as lat"
_VALID = "x0 is not null and lat0 between -90 and 90"
_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_NODES = f"""cur as (select id, geom from (select *, row_number() over (partition by id order by version desc) as rn from nodes) where rn = 1 and visible),
nd as (select id, {_FOLD} from (select id, {_xy("geom")} from cur) where {_VALID})"""
_STEPS = f"""{_NODES},
st as (select way_id, sequence_id, min(node_id) as node_id from way_nodes where node_id is not null group by all),
loc as (select way_id, sequence_id, node_id, lon, lat from st join nd on nd.id = st.node_id),
cnt as (select node_id, count(*) as uses from loc group by node_id)"""
_TAG = "nullif(regexp_extract(tags, '\"{k}\"=>\"([^\"]*)\"', 1), '')"
_SPEED = "case when contains({t}, 'mph') then try_cast(case when regexp_matches(split_part({t}, ' ', 1), '^[0-9]+$') then split_part({t}, ' ', 1) end as int) * 1.609 else try_cast(case when regexp_matches({t}, '^[0-9]+$') then {t} end as int) end"
_ONEWAY = f"(coalesce({_TAG.format(k='oneway')} in ('yes', 'true', '1'), false) or coalesce(regexp_matches(tags, '\"(junction|roundabout)\"=>'), false))"


def _speed(kind: str) -> str:
    one, both = _SPEED.format(t=_TAG.format(k=f"maxspeed:{kind}")), _SPEED.format(t=_TAG.format(k="maxspeed"))
    return f"coalesce({one}, {both})"


_TYPES = "types(tag, name, class_id, priority, maxspeed) as (values " + ", ".join(f"('{a}', '{b}', {c}, cast({p} as double), {m})" for a, b, c, p, m in src.ROAD_TYPES) + ")"
_SEGMENTS = f"""{_STEPS},
o as (select l.*, c.uses, row_number() over w as i, lead(l.node_id) over w is null as is_last from loc l join cnt c using (node_id) window w as (partition by way_id order by sequence_id)),
c1 as (select *, i > 1 and uses >= 2 and not is_last as is_cut from o),
c2 as (select *, coalesce(sum(is_cut::int) over (partition by way_id order by i rows between unbounded preceding and 1 preceding), 0)::int as s0 from c1),
c3 as (select way_id, i, node_id, lon, lat, unnest(case when is_cut then [s0, s0 + 1] else [s0] end) as seg from c2),
sg as (select way_id, seg, arg_min(node_id, i) as source, arg_max(node_id, i) as target, count(*) as n_points from c3 group by way_id, seg having count(*) >= 2)"""
_BASE = f"""{_SEGMENTS},
{_TYPES},
cw as (select id, tags from (select *, row_number() over (partition by id order by version desc) as rn from ways) where rn = 1 and visible and tags is not null),
cl as (select cw.id as way_id, t.class_id, t.priority, t.maxspeed, {_ONEWAY} as oneway, {_speed("forward")} as mf, {_speed("backward")} as mb from cw join types t on t.name = {_TAG.format(k="highway")}),
base as (select sg.way_id * 10000 + seg as id, source, target, sg.way_id as refid, oneway, class_id as type, priority, coalesce(mf, maxspeed) as mf, coalesce(mb, maxspeed) as mb, seg from sg join cl using (way_id)),
road as (select id * 2 as id, id as base_id, 'forward' as heading, source, target, refid, type, priority, mf as maxspeed, seg from base
  union all select id * 2 + 1, id, 'backward', target, source, refid, type, priority, mb, seg from base where not oneway)"""
_LENGTH = f"""pr as (select a.way_id, a.seg, sum({_HAV.format(a="a", b="b")}) as len from (select *, row_number() over (partition by way_id, seg order by i) as k from c3) a
  join (select *, row_number() over (partition by way_id, seg order by i) as k from c3) b on a.way_id = b.way_id and a.seg = b.seg and b.k = a.k + 1 group by a.way_id, a.seg)"""
_PINGS = f"pg as (select sample_no, id, epoch_ms(time) as time_ms, {_FOLD}, azimuth from (select sample_no, id, time, azimuth, {_xy('point')} from samples where id is not null and time is not null) where {_VALID})"
_PLACES = f"pl as (select row_no as key, {_FOLD} from (select row_no, {_xy('geom')} from x0001_015) where {_VALID})"
_NEAR = f"with {_NODES}, {_PLACES}, hit as (select pl.key, nd.id as target, {_HAV.format(a='pl', b='nd')} as d from pl join nd on nd.lat between pl.lat - 0.0003 and pl.lat + 0.0003)"
_ALLPAIRS = f"with {_NODES}, {_PLACES}, hit as (select pl.key, nd.id as target, {_HAV.format(a='pl', b='nd')} as d from pl, nd)"
_HMM2 = """with st as (select way_id, sequence_id, min(node_id) as node_id from way_nodes where node_id is not null group by all),
x as (select way_id as key, node_id, row_number() over (partition by way_id order by sequence_id) as k from st),
v as (select key, k, node_id, j, case when abs(node_id % 2) = 1 then (case j when 0 then 0.7 else 0.3 end) else (case j when 0 then 0.2 else 0.8 end) end::double as e from x, (select unnest([0, 1]) as j) where k <= 2),
f1 as (select key, j, e / sum(e) over (partition by key) as f, log10(e) as q from v where k = 1),
t as (select b.key, b.j, b.e, a.j as i, a.f, case when a.j = b.j then 0.9 else 0.1 end::double as p, a.q + log10(case when a.j = b.j then 0.9 else 0.1 end::double) + log10(b.e) as q from v b join f1 a on a.key = b.key where b.k = 2 and b.node_id % 17 <> 0),
g as (select key, j, e * sum(p * f) as f, max(q) as q, arg_max(i, (q, -i)) as pred from t group by key, j, e)
"""
_COORDS = "li as (select way_id * 10000 + seg as id, arg_min(lon, i) as lon_a, arg_min(lat, i) as lat_a, arg_max(lon, i) as lon_b, arg_max(lat, i) as lat_b, count(*) as n from c3 group by way_id, seg)"
#: metres on the ellipsoid between near places, by the middle latitude
_W = "(1 - 0.0066943799901413165 * pow(sin(radians((a.lat + b.lat) / 2)), 2))"
_FLAT = f"""6378137.0 * sqrt(pow(radians(b.lat - a.lat) * (1 - 0.0066943799901413165) / pow({_W}, 1.5), 2)
  + pow(radians(((b.lon - a.lon + 180) % 360 + 360) % 360 - 180) * cos(radians((a.lat + b.lat) / 2)) / sqrt({_W}), 2))"""
#: the first later ping that is far and late enough, and on from there
_THIN = f"""with recursive {_PINGS}, u as (select distinct id, time_ms, lon, lat from pg), o as materialized (select *, row_number() over (partition by id order by time_ms) as k from u),
nx as materialized (select a.id, a.k, min(b.k) as nk from o a join o b on a.id = b.id and b.k > a.k and b.time_ms - a.time_ms >= {{ms}} {{far}} group by a.id, a.k),
acc(id, k) as (select distinct id, 1::bigint from o union all select acc.id, nx.nk from acc join nx on nx.id = acc.id and nx.k = acc.k)
select o.id, o.time_ms, o.lon, o.lat from acc join o on o.id = acc.id and o.k = acc.k"""
#: clusters on the ring of seconds of a day: values unrolled three times round
_RING = """with v as (select floor(((epoch_us(ts) % 86400000000) + 86400000000) % 86400000000 / 1e6)::double as x, count(*) as n from events where ts is not null group by 1),
un as (select x + 86400 * t as y, x, n, t from v, (select unnest([-1, 0, 1]) as t)),
nr as (select *, sum(n) over (order by y range between 10 preceding and 10 following) as near from un),
co as (select x, x - coalesce(lag(x) over (order by x), (select max(x) from nr where t = 0 and near >= 4) - 86400) as gap from nr where t = 0 and near >= 4),
sg as (select x, sum((gap > 10)::int) over (order by x) as g from co),
rg as (select x, case when g = 0 then (select max(g) from sg) else g end as g from sg),
cu as (select rg.x + 86400 * t as y, g from rg, (select unnest([-1, 0, 1]) as t)),
bo as (select v.x, max(cu.y) filter (cu.y <= v.x) as lo, min(cu.y) filter (cu.y >= v.x) as hi from v left join cu on cu.y between v.x - 10 and v.x + 10 where v.x not in (select x from rg) group by v.x),
al as (select x, g from rg union all select bo.x, cu.g from bo join cu on cu.y = case when hi is null or bo.x - lo <= hi - bo.x then lo else hi end),
cl as (select al.x, v.n, min(al.x) over (partition by g) as cluster from al join v using (x))"""
_STEPDT = f"with {_PINGS}, dt as (select id, sample_no, time_ms - lag(time_ms) over (partition by id order by time_ms, sample_no) as dt from pg)"

SQL: dict[str, str] = {
    "src_road_types": f"with {_TYPES} select tag, name, class_id::smallint as class_id, priority, maxspeed from types",
    "src_road_scan_filtered": f"with {_BASE} select id, source, target, refid, oneway, type, priority, round(mf * 1000)::bigint as forward, round(mb * 1000)::bigint as backward from base where type not in (114, 117)",
    "src_samples_json": f"""with j as (select json_extract_string(b, '$.id') as id, json_extract_string(b, '$.time') as t, json_extract_string(b, '$.point') as point, json_extract_string(b, '$.azimuth')::double as azimuth
        from (select try_cast(body as json) as b from tracker_messages) where b is not null and json_type(b) = 'OBJECT'),
      k as (select id, case when regexp_matches(t, '^-?[0-9]{{1,18}}$') then t::bigint when regexp_matches(t, '^\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d[+-]\\d\\d(:?\\d\\d)?$') then epoch_ms(try_strptime(t, '%Y-%m-%d %H:%M:%S%z')) end as time_ms, {_xy("point")}, azimuth from j)
      select id, time_ms, {_FOLD}, coalesce(round(((azimuth % 360) + 360) % 360 * 1000)::bigint, -1) as azimuth_milli from k where id is not null and time_ms is not null and {_VALID}""",
    "snk_last_value": f"with {_PINGS} select id, time_ms, lon, lat from (select *, row_number() over (partition by id order by time_ms desc, lon desc, lat desc) as rn from pg) where rn = 1",
    "imp_way_nodes_join": f"with {_STEPS} select way_id, sequence_id, node_id, lon, lat from loc",
    "imp_node_counts": f"with {_STEPS} select node_id, uses from cnt",
    "imp_way_aggs": f"with {_STEPS} select way_id, string_agg(sequence_id::varchar, ',' order by sequence_id) as seqs, string_agg(node_id::varchar, ',' order by sequence_id) as nodes, string_agg(uses::varchar, ',' order by sequence_id) as counts from loc join cnt using (node_id) group by way_id",
    "imp_oneway": f"select tags, {_ONEWAY} as oneway from (select distinct tags from ways)",
    "imp_maxspeed": f"select tags, coalesce(round({_speed('forward')} * 1000)::bigint, -1) as forward, coalesce(round({_speed('backward')} * 1000)::bigint, -1) as backward from (select distinct tags from ways)",
    "imp_segments": f"with {_SEGMENTS} select way_id, seg::bigint as seg, source, target, n_points::int as n_points from sg",
    "geo_distance": f"with {_NODES}, o as (select 11.0::double as lon, 48.0::double as lat) select id as key, round({_HAV.format(a='nd', b='o')} * 1000)::bigint as mm from nd, o",
    "geo_length": f"with {_STEPS}, q as (select *, lead(lon) over w as lon2, lead(lat) over w as lat2 from loc window w as (partition by way_id order by sequence_id)), a as (select way_id, lon, lat, struct_pack(lon := lon2, lat := lat2) as b from q where lat2 is not null) select way_id, round(sum({_HAV.format(a='a', b='b')}) * 100)::bigint as cm from a group by way_id",
    "geo_heading_diff": "with a as (select sample_no, case when isnan(azimuth) then null else ((azimuth % 360) + 360) % 360 end as z from samples) select sample_no, round(least(abs(z - 350), 360 - abs(z - 350)) * 1000)::bigint as milli from a where z is not null",
    "geo_wkt": f"with {_PLACES} select key as row_no, round(lon * 1e6)::bigint as lon, round(lat * 1e6)::bigint as lat from pl",
    "geo_reverse": f"with {_BASE}, {_COORDS} select id, round(lon_b * 1e6)::bigint as lon1, round(lat_b * 1e6)::bigint as lat1, round(lon_a * 1e6)::bigint as lon2, round(lat_a * 1e6)::bigint as lat2, n::int as n from li join base using (id)",
    "geo_envelope": f"""with {_NODES}, w as (select id as key, lon, lat, 1 - 0.0066943799901413165 * pow(sin(radians(lat)), 2) as w from nd),
      r as (select key, lon, lat, degrees(100 / (6378137.0 * (1 - 0.0066943799901413165) / pow(w, 1.5))) as dy, degrees(100 / (6378137.0 / sqrt(w) * cos(radians(lat)))) as dx from w)
      select key, round((((lon - dx + 180) % 360 + 360) % 360 - 180) * 1e6)::bigint as west, round((lat - dy) * 1e6)::bigint as south, round((((lon + dx + 180) % 360 + 360) % 360 - 180) * 1e6)::bigint as east, round((lat + dy) * 1e6)::bigint as north from r""",
    "src_duplicate_times": f"with {_PINGS} select id, time_ms, count(*) as n from pg group by all having count(*) > 1",
    "map_json": f"""with {_BASE} select id, '{{"road":' || base_id || ',"heading":"' || heading || '"}}' as json from road""",
    "graph_components": f"""with recursive {_BASE}, e as materialized (select source as a, target as b from road union select target, source from road),
      lab(v, l) using key (v) as (select distinct a, a from e union select e.b, min(lab.l) from lab join e on e.a = lab.v join recurring.lab as cur on cur.v = e.b where lab.l < cur.l group by e.b)
      select id, l as component from road join lab on lab.v = road.source""",
    "mm_thin": _THIN.format(ms=5000, far=f"and {_FLAT} >= 10"),
    "st_thin": _THIN.format(ms=60000, far=""),
    "cl_cyclic": _RING + " select x, n, cluster from cl",
    "cl_bounds": _RING + """, gp as (select cluster, x, coalesce(lead(x) over w, min(x) over (partition by cluster)) as nx, coalesce(lead(x) over w, min(x) over (partition by cluster) + 86400) - x as gap from cl window w as (partition by cluster order by x)),
      b as (select *, row_number() over (partition by cluster order by gap desc, x) as r from gp)
      select cluster, case when gap > 10 + 1e-10 then ((nx - 5) % 86400 + 86400) % 86400 end as low, case when gap > 10 + 1e-10 then (x + 5) % 86400 end as high from b where r = 1""",
    "cl_dbscan": f"""with recursive {_NODES}, pt as (select row_number() over (order by lon, lat) as k, lon, lat from (select distinct lon, lat from nd)),
      nb as (select a.k as a, b.k as b, {_HAV.format(a='a', b='b')} as d from pt a join pt b on b.lat between a.lat - 0.0006 and a.lat + 0.0006),
      ne as materialized (select * from nb where d < 60), core as materialized (select a as k from ne group by a having count(*) >= 4),
      ce as materialized (select a, b from ne where a in (select k from core) and b in (select k from core)),
      lab(v, l) using key (v) as (select k, k from core union select ce.b, min(lab.l) from lab join ce on ce.a = lab.v join recurring.lab as cur on cur.v = ce.b where lab.l < cur.l group by ce.b),
      m as (select v as k, l from lab union all select a, arg_min(lab.l, (ne.d, lab.l)) from ne join lab on lab.v = ne.b where ne.a not in (select k from core) group by a),
      n as (select l, min(k) as least from m group by l)
      select round(p.lon * 1e6)::bigint as lon, round(p.lat * 1e6)::bigint as lat, round(q.lon * 1e6)::bigint as cluster_lon, round(q.lat * 1e6)::bigint as cluster_lat from m join n using (l) join pt p on p.k = m.k join pt q on q.k = n.least""",
    "geo_in_polygon": f"with {_NODES} select id as key from nd where lon > 9.3 and lon < 9.5 and lat > 51.2 and lat < 51.32",
    "idx_radius": f"{_NEAR} select key, target, round(d * 1000)::bigint as mm from hit where d < 30",
    "idx_nearest": f"{_ALLPAIRS} select key, target, round(d * 1000)::bigint as mm from (select *, rank() over (partition by key order by d) as r from hit) where r = 1",
    "idx_knearest": f"{_ALLPAIRS} select key, target, r::int as rank from (select *, row_number() over (partition by key order by d, target) as r from hit) where r <= 3",
    "map_split": f"with {_BASE} select id, base_id, heading, source, target, type, round(maxspeed * 1000)::bigint as maxspeed from road",
    "graph_successors": f"with {_BASE} select a.id, b.id as successor from road a join road b on a.target = b.source",
    "cost_time_priority": f"with {_BASE}, {_LENGTH} select r.id, round(round(len, 2) * 3.6 / least(maxspeed, 130) * greatest(1.0, priority) * 1000)::bigint as cost_ms from road r join pr on pr.way_id = r.refid and pr.seg = r.seg",
    "route_cost": f"with {_BASE}, {_LENGTH}, e as (select b.refid as path_id, b.id, round(len, 2) as len from base b join pr on pr.way_id = b.refid and pr.seg = b.seg) select path_id, round((sum(len) - arg_min(len, id) * 0.25 - arg_max(len, id) * 0.25) * 1e4)::bigint as cost_tenth_mm, count(*)::int as n_edges from e group by path_id",
    "path_valid": f"with {_BASE}, e as (select refid as path_id, source, lag(target) over (partition by refid order by id) as before from base) select path_id, bool_and(before is null or before = source) as valid from e group by path_id",
    "route_concat": f"with {_BASE}, e as (select refid as path_id, source, lag(target) over w as before, row_number() over w as k, count(*) over (partition by refid) as n from base window w as (partition by refid order by id)) select path_id, (case when before = source then n else 1 end)::int as n_edges, before = source as ok, 0.25::double as source_frac, (case when before = source then 0.75 else 1.0 end)::double as target_frac from e where k = 2",
    "mm_emission": f"{_NEAR} select key, target, round(exp(-0.5 * round(d, 3) * round(d, 3) / 100) / sqrt(2 * pi() * 100) * 1e9)::bigint as nano from hit where d < 30",
    "mm_bound": f"{_STEPDT} select id, sample_no, greatest(1000.0, least(15000.0, floor(dt / 1000.0) * 100))::double as bound from dt where dt is not null",
    "mm_transition": f"{_STEPDT} select id, sample_no, round(exp(-10.0 / (greatest(1.0, dt) / 1000)) / (greatest(1.0, dt) / 1000) * 1e9)::bigint as nano from dt where dt is not null",
    "hmm_initial": _HMM2 + "select key, j, round(f * 1e9)::bigint as filtprob, round(q * 1e9)::bigint as seqprob, -1 as pred, true as fresh from f1",
    "hmm_step": _HMM2 + "select key, j, round(f / sum(f) over (partition by key) * 1e9)::bigint as filtprob, round(q * 1e9)::bigint as seqprob, pred, false as fresh from g",
    "hmm_break": _HMM2 + "select key, j, round(e / sum(e) over (partition by key) * 1e9)::bigint as filtprob, round(log10(e) * 1e9)::bigint as seqprob, -1 as pred, true as fresh from v where k = 2 and node_id % 17 = 0",
    "ev_subsample": f"with {_PINGS}, u as (select distinct id, time_ms from pg), v as (select *, min(time_ms) over (partition by id) as a, max(time_ms) over (partition by id) as b from u) select id, time_ms from v where ((time_ms - a) // 1000) % 30 = 0 or time_ms in (a, b)",
    "st_latest_state": f"with {_PINGS} select id, time_ms, lon, lat from (select *, row_number() over (partition by id order by time_ms desc, lon desc, lat desc) as rn from pg) where rn = 1",
    "st_late_flags": f"with {_PINGS} select sample_no, coalesce(time_ms < max(time_ms) over (partition by id order by sample_no rows between unbounded preceding and 1 preceding), false) as late from pg",
    "st_sessions_by_ttl": """with e as (select distinct id, time from samples where id is not null and time is not null),
      f as (select *, case when epoch_us(time) - lag(epoch_us(time)) over (partition by id order by time) <= 60000000 then 0 else 1 end as s from e),
      g as (select *, sum(s) over (partition by id order by time) as k from f)
      select id, epoch_ms(min(time)) as start_ms, epoch_ms(max(time)) as end_ms, epoch_ms(max(time)) - epoch_ms(min(time)) as duration_ms, count(*) as n_events from g group by id, k""",
    "cl_1d": """with v as (select value as x, count(*) as n from events where value is not null group by value),
      c as (select *, sum(n) over (order by x range between 0.01::double preceding and 0.01::double following) as near from v),
      k as (select x, case when x - lag(x) over (order by x) <= 0.01 then null else x end as b from c where near >= 3),
      g as (select x, max(b) over (order by x) as cluster from k),
      j as (select c.x, c.n, max(g.x) filter (g.x <= c.x) as lo, min(g.x) filter (g.x >= c.x) as hi from (select x, n from c where near < 3) c left join g on g.x between c.x - 0.01 and c.x + 0.01 group by c.x, c.n)
      select x, n, cluster from g join v using (x)
      union all select j.x, j.n, g.cluster from (select x, n, case when hi is null or x - lo <= hi - x then lo else hi end as m from j where lo is not null or hi is not null) j join g on g.x = j.m""",
}
