"""The p-queries of the core: trips, timestamps, references, proximity, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.geometry import point
from wayline.operators.activity import sessions
from wayline.operators.proximity import near_points, zones_around
from wayline.operators.references import orphan_references, orphan_report
from wayline.operators.timestamps import normalise_messages, normalise_sequences
from wayline.operators.trips import stops_and_trips
from wayline.session import cut

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_trips(spark: SparkSession, d: str) -> DataFrame:
    return stops_and_trips(table(spark, d, "samples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_trips(spark, d).select("kind", "id", "start_ms", "end_ms")


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    devices = table(spark, d, "devices")
    a = normalise_sequences(table(spark, d, "x0001_015"), devices).select(F.lit("x0001_015").alias("src"), "row_no", "utc_us")
    b = normalise_messages(table(spark, d, "tracker_messages"), devices).select(F.lit("tracker_messages").alias("src"), "row_no", "utc_us")
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_normalised(spark, d).where("utc_us is not null")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "way_nodes"), table(spark, d, "nodes"), table(spark, d, "ways"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "way_id", "sequence_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Position of the highest version of each node that is visible and has one: key, lon, lat. Ties of version: the invisible counts."""
    last = F.max(F.struct(F.coalesce(F.col("version"), F.lit(-1)).alias("v"), F.coalesce(~F.col("visible"), F.lit(False)).alias("gone"), point(F.col("geom")).alias("p")))
    x = nodes.where("id is not null").groupBy(F.col("id").alias("key")).agg(last.alias("r")).where("not r.gone and r.p is not null")
    return x.select("key", "r.p.lon", "r.p.lat")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of x0001_015, parsed and written once, as the joins read them several times."""
    x = table(spark, d, "x0001_015").select(F.col("row_no").alias("key"), point(F.col("geom")).alias("p")).where("p is not null")
    return cut(x.select("key", "p.lon", "p.lat"))


def _near_nodes(at: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    x = near_points(at, cut(current_nodes(table(spark, d, "nodes"))), 20.0)
    return x.select(F.lit("node").alias("near"), F.col("left_key").alias("row_no"), F.col("right_key").alias("ref_id"))


def _zones(at: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    x = zones_around(at, table(spark, d, "zones").select(F.col("zone_id").alias("key"), "geom"))
    return x.select(F.lit("zone").alias("near"), F.col("left_key").alias("row_no"), F.col("right_key").alias("ref_id"))


def p5_near_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _near_nodes(_positions(spark, d), spark, d)


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    return _zones(_positions(spark, d), spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    at = _positions(spark, d)
    return _near_nodes(at, spark, d).unionByName(_zones(at, spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "samples")).select("id", "start_ms", "end_ms")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "samples"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_trips": p1_trips,
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_near_nodes": p5_near_nodes,
    "p5_zones": p5_zones,
    "p6_found": p6_found,
    "p6_sessions": p6_sessions,
}

_ORPHANS = """
with refs as (
  select 'nodes' as ref_table, node_id as k, way_id, sequence_id, tstamp from way_nodes where node_id is not null
  union all select 'ways', way_id, way_id, sequence_id, tstamp from way_nodes where way_id is not null),
parents as (
  select 'nodes' as ref_table, id, max_by(visible, version) as vis, min(tstamp) as since from nodes group by id
  union all select 'ways', id, max_by(visible, version), min(tstamp) from ways group by id),
misses as (
  select distinct r.ref_table, r.way_id, r.sequence_id, r.tstamp,
    case when p.id is null then 'missing' when not p.vis then 'deleted' else 'later' end as reason
  from refs r left join parents p on p.ref_table = r.ref_table and p.id = r.k
  where p.id is null or not p.vis or p.since > r.tstamp)
"""
_SESSIONS = """
with e as (select distinct id, time from samples where id is not null and time is not null),
f as (select *, case when epoch_us(time) - lag(epoch_us(time)) over (partition by id order by time) <= 1800000000 then 0 else 1 end as s from e),
g as (select *, sum(s) over (partition by id order by time) as k from f)
"""
_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: DuckDB: lon and lat of the WKT spellings
_XY = rf"regexp_extract(geom, '^\s*(?:SRID=\d+;)?(?i:POINT)\s*(?:Z|M|ZM)?\s*\(\s*({_NUM})\s+({_NUM})[^)]*\)\s*$', ['x', 'y'])"
SQL: dict[str, str] = {
    "p4_found": _ORPHANS + "select distinct ref_table, way_id, sequence_id from misses",
    "p4_report": _ORPHANS + "select ref_table, strftime(date_trunc('month', tstamp), '%Y-%m-%d') as period, reason, count(*) as n_refs from misses group by all",
    "p6_found": _SESSIONS + "select id, epoch_ms(min(time)) as start_ms, epoch_ms(max(time)) as end_ms from g group by id, k",
    "p6_sessions": _SESSIONS + "select id, epoch_ms(min(time)) as start_ms, epoch_ms(max(time)) as end_ms, epoch_ms(max(time)) - epoch_ms(min(time)) as duration_ms, count(*) as n_events from g group by id, k",
}
