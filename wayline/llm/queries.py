"""The p-queries on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.encoding import encode_corpus
from wayline.llm.mixing import mix_sources
from wayline.llm.reading import reading_levels
from wayline.llm.runs import position_runs
from wayline.operators.timestamps import normalise_sequences
from wayline.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """Runs as single events, with durations from the normalised times."""
    traces = _table(spark, d, "x0001_015")
    times = normalise_sequences(traces, _table(spark, d, "devices")).select("row_no", "utc_us")
    return position_runs(traces.join(times, "row_no"), time_us_col="utc_us").select("id", "first_seq", "last_seq", "n_events", "start_us", "end_us", "duration_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return position_runs(_table(spark, d, "x0001_015")).select("id", "first_seq", "last_seq")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_table(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_table(spark, d, "documents"), keep=["source"]).select("doc_id", "source", F.size("ids").alias("n_tokens"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_sizes(spark, d), _table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_budget(spark: SparkSession, d: str) -> DataFrame:
    """Shares at a budget of all tokens there are, at which small sources repeat up to their caps, run out and fall short."""
    sizes = cut(_sizes(spark, d))
    return mix_sources(sizes, _table(spark, d, "mix_targets"), budget=sizes.agg(F.sum("n_tokens")).first()[0] or 0)[1]


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).select("doc_id", "band")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_events": p3_events,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_budget": p8_budget,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}
_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: DuckDB: lon and lat of the WKT spellings
_XY = rf"regexp_extract(geom, '^\s*(?:SRID=\d+;)?(?i:POINT)\s*(?:Z|M|ZM)?\s*\(\s*({_NUM})\s+({_NUM})[^)]*\)\s*$', ['x', 'y'])"
_RUNS = f"""
with p as (select id, seq, {_XY} as g from x0001_015 where id is not null and seq is not null),
q as (select id, seq, try_cast(g.x as double) as x, try_cast(g.y as double) as y from p),
one as (select id, seq, min(struct_pack(x := ((x + 180) % 360 + 360) % 360 - 180, y := y)) filter (where x is not null and y between -90 and 90) as p from q group by id, seq),
l as (select *, lag(p) over (partition by id order by seq) as o from one),
f as (select *, case when p is null or o is null then 1 when 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p.y - o.y) / 2), 2)
  + cos(radians(p.y)) * cos(radians(o.y)) * pow(sin(radians(p.x - o.x) / 2), 2)))) <= 3 then 0 else 1 end as s from l),
k as (select *, sum(s) over (partition by id order by seq) as run from f)
select id, min(seq)::bigint as first_seq, max(seq)::bigint as last_seq from k group by id, run having count(*) > 1
"""
#: No SQL expresses encoding, mixing by its sizes, or reading levels; tests/llm compares with plain versions.
SQL: dict[str, str] = {
    "p3_found": _RUNS,
}
