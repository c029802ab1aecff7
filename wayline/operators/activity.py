"""Sessions: split each device's events at inactivity (start-end pairing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.times import utc_micros
from wayline.session import cut

DAY_US = 86_400_000_000


def sessions(events: DataFrame, id_col: str = "id", time_col: str = "time", gap_ms: int = 1_800_000, bucket_us: int = DAY_US) -> DataFrame:
    """Sessions of each id: (id, start_ms, end_ms, duration_ms, n_events).

    A silence of more than ``gap_ms`` between successive events of an id starts a new session. Events alike in id and time
    count once; rows with null id or time do not count; a lone event is a session; an empty table gives no row. Other
    columns of ``events`` are ignored, whatever their names.

    Start-end pairing. The events of an id are cut into time buckets with a halo of one gap on either side, so that a hot id
    spreads over the cluster. Inside a bucket RANGE frames find the events without a gap-near predecessor (starts) or
    successor (ends). Starts, ends and events are numbered separately: by row_number in the bucket plus the totals of the
    id's earlier buckets. Starts and ends of equal number join, and the difference of their event numbers is the count.
    """
    gap = gap_ms * 1000
    if bucket_us <= 2 * gap:
        raise ValueError("a bucket must be longer than two gaps")
    us = utc_micros(events, time_col)
    pings = events.select(F.col(id_col).alias("id"), us.alias("t")).where("id is not null and t is not null").distinct()
    home = F.floor(F.col("t") / bucket_us)
    near = F.array_distinct(F.array(F.floor((F.col("t") - gap) / bucket_us), home, F.floor((F.col("t") + gap) / bucket_us)))
    spread = pings.select("id", "t", F.explode(near).alias("b")).withColumn("own", F.col("b") == home).repartition("id", "b")

    w = Window.partitionBy("id", "b").orderBy("t")
    all_ = Window.partitionBy("id", "b")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = (
        spread.withColumn("first", F.count("*").over(w.rangeBetween(-gap, -1)) == 0)
        .withColumn("last", F.count("*").over(w.rangeBetween(1, gap)) == 0)
        .withColumn("own_n", F.col("own").cast("int"))
        .withColumn("n", F.sum("own_n").over(upto))
        .withColumn("starts", F.sum((F.col("own") & F.col("first")).cast("int")).over(upto))
        .withColumn("ends", F.sum((F.col("own") & F.col("last")).cast("int")).over(upto))
        .withColumn("closes", F.col("t") == F.max(F.when(F.col("own"), F.col("t"))).over(all_))
        .where("own and (first or last or closes)")
    )
    marks = cut(flagged.select("id", "b", "t", "first", "last", "closes", "n", "starts", "ends"))
    before = Window.partitionBy("id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = marks.where("closes").select(
        "id",
        "b",
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "starts", "ends")),
    )
    numbered = marks.join(base, ["id", "b"])
    begin = numbered.where("first").select("id", (F.col("starts") + F.col("starts0")).alias("k"), F.col("t").alias("t1"), (F.col("n") + F.col("n0")).alias("r1"))
    end = numbered.where("last").select("id", (F.col("ends") + F.col("ends0")).alias("k"), F.col("t").alias("t2"), (F.col("n") + F.col("n0")).alias("r2"))
    ms = lambda c: F.floor(F.col(c) / 1000)
    return begin.join(end, ["id", "k"]).select(
        "id",
        ms("t1").alias("start_ms"),
        ms("t2").alias("end_ms"),
        (ms("t2") - ms("t1")).alias("duration_ms"),
        (F.col("r2") - F.col("r1") + 1).alias("n_events"),
    )
