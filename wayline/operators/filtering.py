"""The filter step as joins, for many traces at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_step(before: DataFrame, now: DataFrame, transitions: DataFrame) -> DataFrame:
    """Next vectors: (key, j, filtprob, seqprob, pred, fresh) from before (key, i, filtprob, seqprob), now (key, j, emission), transitions (key, i, j, p).

    filtprob is the emission times the sum of transition times filtprob before, scaled to sum 1 per key; seqprob the greatest log10 sum, pred its candidate
    (ties: the smaller). Candidates without a way to them are dropped; where none survives, or nothing was before, all with an emission begin
    anew (fresh): filtprob from the emission, seqprob its log10, pred null. Null or zero transitions and emissions count as none.
    """
    ways = transitions.where("p > 0").join(before, ["key", "i"]).join(now.where("emission > 0"), ["key", "j"])
    ways = ways.withColumn("q", F.col("seqprob") + F.log10("p") + F.log10("emission"))
    best = F.max(F.struct("q", (-F.col("i")).alias("order"))).alias("b")
    live = ways.groupBy("key", "j", "emission").agg((F.sum(F.col("p") * F.col("filtprob"))).alias("s"), best)
    live = live.select("key", "j", (F.col("emission") * F.col("s")).alias("f"), F.col("b.q").alias("seqprob"), (-F.col("b.order")).alias("pred"), F.lit(False).alias("fresh"))
    lost = now.where("emission > 0").join(live.select("key").distinct(), "key", "left_anti")
    fresh = lost.select("key", "j", F.col("emission").alias("f"), F.log10("emission").alias("seqprob"), F.lit(None).cast(before.schema["i"].dataType).alias("pred"), F.lit(True).alias("fresh"))
    total = F.sum("f").over(Window.partitionBy("key"))
    return live.unionByName(fresh).select("key", "j", (F.col("f") / total).alias("filtprob"), "seqprob", "pred", "fresh")
