"""Runs of (nearly) identical consecutive events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geometry import haversine, point


def position_runs(
    events: DataFrame, id_col: str = "id", seq_col: str = "seq", geom_col: str = "geom", time_us_col: str | None = None, max_m: float = 3.0, min_events: int = 2, block: int = 1024
) -> DataFrame:
    """Longest runs of consecutive events at (nearly) one position: (id, first_seq, last_seq, n_events, lon, lat, start_us, end_us, duration_us).

    Events of an id are taken in order of ``seq``, one per (id, seq): of rows sent again the least point that is not null
    counts, and the least time. Each event of a run lies at most ``max_m`` from the one before; an event without position is
    in no run and ends one. Rows with null id or seq do not count. start, end and duration are null without ``time_us_col``.
    An empty table gives no row; other columns are ignored.

    Lag window, change flags, running sum as run number, aggregation by run. Done per block of ``block`` sequence numbers
    first, so that a hot id spreads over the cluster; then only the runs at the rims of blocks are compared along the id.
    """
    time = F.col(time_us_col) if time_us_col else F.lit(None).cast("long")
    one = (
        events.select(F.col(id_col).alias("id"), F.col(seq_col).cast("long").alias("seq"), point(F.col(geom_col)).alias("p"), time.alias("us"))
        .where("id is not null and seq is not null")
        .groupBy("id", "seq")
        .agg(F.min("p").alias("p"), F.min("us").alias("us"))
        .withColumn("b", F.floor(F.col("seq") / block))
        .repartition("id", "b")
    )
    far = lambda a, b: F.coalesce(haversine(a["lon"], a["lat"], b["lon"], b["lat"]) > max_m, F.lit(True))

    w = Window.partitionBy("id", "b").orderBy("seq")
    parts = (
        one.withColumn("change", far(F.lag("p").over(w), F.col("p")).cast("int"))
        .withColumn("run", F.sum("change").over(w))
        .groupBy("id", "b", "run")
        .agg(
            F.min("seq").alias("s1"), F.max("seq").alias("s2"), F.count("*").alias("n"),
            F.min_by("p", "seq").alias("p1"), F.max_by("p", "seq").alias("p2"), F.min("us").alias("u1"), F.max("us").alias("u2"),
        )
        .withColumn("opens", F.col("s1") == F.min("s1").over(Window.partitionBy("id", "b")))
        .withColumn("closes", F.col("s2") == F.max("s2").over(Window.partitionBy("id", "b")))
        # runs inside a block are complete: each is alone in a group of its own
        .withColumn("g", F.when(F.col("opens") | F.col("closes"), F.lit(-1)).otherwise(F.col("s1")))
    )
    v = Window.partitionBy("id", "g").orderBy("s1")
    whole = (
        parts.withColumn("change", (~F.col("opens") | far(F.lag("p2").over(v), F.col("p1"))).cast("int"))
        .withColumn("run", F.sum("change").over(v))
        .groupBy("id", "g", "run")
        .agg(F.min("s1").alias("first_seq"), F.max("s2").alias("last_seq"), F.sum("n").alias("n_events"), F.min_by("p1", "s1").alias("p"), F.min("u1").alias("start_us"), F.max("u2").alias("end_us"))
        .where(F.col("n_events") >= min_events)
    )
    return whole.select("id", "first_seq", "last_seq", "n_events", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"))
