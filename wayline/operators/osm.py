"""From map tables (nodes, ways, way_nodes) to base roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geometry import haversine, point
from wayline.session import made


def current(versions: DataFrame) -> DataFrame:
    """The highest version of each id, if visible (ties: the row that is greatest by its other columns of simple type)."""
    cols = [c for c in versions.columns if c not in ("id", "version")]
    last = F.max(F.struct(F.coalesce("version", F.lit(-1)).alias("version"), *(F.col(c) for c in cols)))
    return versions.where("id is not null").groupBy("id").agg(last.alias("r")).select("id", "r.*").where("visible")


def steps(way_nodes: DataFrame) -> DataFrame:
    """One row per (way_id, sequence_id) with a node: repeated rows count once."""
    return way_nodes.where("way_id is not null and sequence_id is not null and node_id is not null").groupBy("way_id", "sequence_id").agg(F.min("node_id").alias("node_id"))


def located_steps(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps joined with the current position of their node: (way_id, sequence_id, node_id, lon, lat); steps without one are dropped."""
    n = current(nodes.select("id", "version", "visible", "geom")).select(F.col("id").alias("node_id"), point(F.col("geom")).alias("p")).where("p is not null")
    return steps(way_nodes).join(n, "node_id").select("way_id", "sequence_id", "node_id", "p.lon", "p.lat")


def node_counts(located: DataFrame) -> DataFrame:
    """(node_id, uses): how often ways use a node; a closed way counts its joint twice."""
    return located.groupBy("node_id").agg(F.count("way_id").alias("uses"))


def way_arrays(located: DataFrame) -> DataFrame:
    """One row per way: its steps in order, with use counts: (way_id, steps array<struct<sequence_id, node_id, uses, lon, lat>>)."""
    counted = located.join(node_counts(located), "node_id")
    return counted.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("sequence_id", "node_id", "uses", "lon", "lat"))).alias("steps"))


def tag_entries(hstore: Column) -> Column:
    """array<struct<key, value>> of hstore text '"k"=>"v", ...', in order; values NULL are null; null or malformed text has none."""
    pattern = r'"((?:[^"\\]|\\.)*)"\s*=>\s*(?:"((?:[^"\\]|\\.)*)"|NULL)'
    clean = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    keys, values = F.regexp_extract_all(hstore, F.lit(pattern), F.lit(1)), F.regexp_extract_all(hstore, F.lit(pattern), F.lit(2))
    whole = F.regexp_extract_all(hstore, F.lit(pattern), F.lit(0))
    return F.coalesce(
        F.transform(F.arrays_zip(keys.alias("k"), values.alias("v"), whole.alias("w")), lambda z: F.struct(clean(z["k"]).alias("key"), F.when(~z["w"].endswith("NULL") | (z["v"] != ""), clean(z["v"])).alias("value"))),
        F.array().cast("array<struct<key:string,value:string>>"),
    )


def tag(entries: Column, key: str) -> Column:
    """Value of a key; the last of repeated ones; null if absent."""
    return F.get(F.transform(F.filter(F.reverse(entries), lambda e: e["key"] == key), lambda e: e["value"]), F.lit(0))


def speed(text: Column) -> Column:
    """km/h of '50' or '60 mph'; null for anything else ('60mph', 'walk')."""
    return F.when(text.contains("mph"), F.get(F.split(text, " "), F.lit(0)).try_cast("int") * F.lit(1.609)).otherwise(text.try_cast("int").cast("double"))


def road_tags(df: DataFrame, hstore: str = "tags") -> DataFrame:
    """Adds e (tag entries), oneway, maxspeed_forward and maxspeed_backward.

    oneway: oneway yes, true or 1, or any junction or roundabout key. Speeds: maxspeed, which the directed tags override where they parse.
    """
    x = made(df, e=tag_entries(F.col(hstore)))
    e = F.col("e")
    x = made(x, __s=tag(e, "maxspeed"), __f=tag(e, "maxspeed:forward"), __b=tag(e, "maxspeed:backward"), __o=tag(e, "oneway"), __j=F.exists(e, lambda v: v["key"].isin("junction", "roundabout")))
    x = made(
        x,
        oneway=F.coalesce(F.col("__o").isin("yes", "true", "1"), F.lit(False)) | F.col("__j"),
        maxspeed_forward=F.coalesce(speed(F.col("__f")), speed(F.col("__s"))),
        maxspeed_backward=F.coalesce(speed(F.col("__b")), speed(F.col("__s"))),
    )
    return x.drop("__s", "__f", "__b", "__o", "__j")


def classified_ways(ways: DataFrame, types: DataFrame) -> DataFrame:
    """Current ways with a road class (the last matching tag counts): (way_id, class_id, priority, oneway, maxspeed_forward, maxspeed_backward)."""
    w = road_tags(current(ways.select("id", "version", "visible", "tags"))).where(F.size("e") > 0)
    w = w.select(F.col("id").alias("way_id"), "oneway", "maxspeed_forward", "maxspeed_backward", F.posexplode("e").alias("pos", "t"))
    known = F.broadcast(types.select("tag", "name", "class_id", "priority"))  # the configuration: some dozens of classes
    hits = w.join(known, (F.col("t.key") == F.col("tag")) & (F.col("t.value") == F.col("name")))
    best = F.max(F.struct("pos", "class_id", "priority", "oneway", "maxspeed_forward", "maxspeed_backward")).alias("r")
    return hits.groupBy("way_id").agg(best).select("way_id", "r.class_id", "r.priority", "r.oneway", "r.maxspeed_forward", "r.maxspeed_backward")


def segments(located: DataFrame) -> DataFrame:
    """Ways cut at nodes used twice or more and at their ends: (way_id, seg, source, target, coords); ways of one node give none.

    A running count of cuts numbers the segments; the node at a cut ends one and begins the next. Windows are per way, whose length the
    map format bounds.
    """
    x = located.join(node_counts(located), "node_id")
    w = Window.partitionBy("way_id").orderBy("sequence_id")
    x = x.withColumn("i", F.row_number().over(w)).withColumn("last", F.lead("node_id").over(w).isNull())
    x = x.withColumn("is_cut", (F.col("i") > 1) & (F.col("uses") >= 2) & ~F.col("last"))
    x = x.withColumn("seg", F.coalesce(F.sum(F.col("is_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("seg", F.explode(F.when(F.col("is_cut"), F.array("seg", F.col("seg") + 1)).otherwise(F.array("seg"))))
    part = F.sort_array(F.collect_list(F.struct("i", "node_id", "lon", "lat")))
    return (
        x.groupBy("way_id", "seg").agg(part.alias("p")).where(F.size("p") >= 2)
        .select("way_id", "seg", F.col("p")[0]["node_id"].alias("source"), F.element_at("p", -1)["node_id"].alias("target"), F.transform("p", lambda e: F.struct(e["lon"].alias("lon"), e["lat"].alias("lat"))).alias("coords"))
    )


def polyline_length(coords: Column) -> Column:
    """Great-circle length of array<struct<lon, lat>>."""
    pairs = F.arrays_zip(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))).alias("a"), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, z: s + haversine(z["a"]["lon"], z["a"]["lat"], z["b"]["lon"], z["b"]["lat"]))


def base_roads(nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Base roads of the current map: classified ways cut into segments. id = way id * 10000 + segment number."""
    located = located_steps(way_nodes, nodes)
    s = segments(located).join(classified_ways(ways, types), "way_id")
    return s.select(
        (F.col("way_id") * 10000 + F.col("seg")).alias("id"), "source", "target", F.col("way_id").alias("refid"), "oneway", F.col("class_id").alias("type"), "priority",
        "maxspeed_forward", "maxspeed_backward", polyline_length(F.col("coords")).alias("length"), "coords",
    )
