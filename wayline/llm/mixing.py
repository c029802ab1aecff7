"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import cut

#: Aimed number of documents in one stretch of a source's queue.
STRETCH = 50_000


def mix_sources(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """A mixture and its shares, from sizes (doc_id, source, n_tokens) and targets (source, weight, max_repeat).

    Mixture: (source, doc_id, copy, n_tokens, finish), in the order of ``finish``. Every source passes through its documents in a
    shuffled order, up to ``max_repeat`` times, each pass in another order; a document's virtual finish time is the source's
    tokens up to and with it, over the source's weight, the weights of the usable sources scaled to sum 1. The queue, range-sorted by that
    time over all sources (ties: source, document, copy), is cut where its tokens would pass ``budget``: without one, the largest budget at which
    every source can still keep its share; with a larger one, sources that run out fall short and the others go on. So the mixture
    misses the budget by less than one document, unless all sources run out.

    Shares: (source, weight, max_repeat, target_share, available_tokens, n_uses, n_tokens, actual_share, exhausted), one row per source on
    either side. Unusable sources (no target, weight or repeats null, zero or negative, no tokens) have actual share 0; their weight is not
    given to target_share. Documents without tokens or source are never used. No usable source: an empty mixture.
    """
    docs = cut(sizes.where("n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")))
    per = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("n_docs"), F.max("n_tokens").alias("longest"))
    asked = targets.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    both = per.join(asked, "source")
    # one row per target: bounded by the target table
    usable = both.where("weight > 0 and weight < double('infinity') and max_repeat > 0").collect()
    total_weight = sum(r["weight"] for r in usable)
    share = {r["source"]: r["weight"] / total_weight for r in usable}
    room = {r["source"]: r["available_tokens"] * r["max_repeat"] for r in usable}
    ends = sorted(room[s] / share[s] for s in share)
    if budget is None:
        budget = int(ends[0] * (1 + 1e-12)) if ends else 0
    # no document that finishes after this time is within the budget: only so many passes are laid out
    reached = lambda v: sum(min(share[s] * v, room[s]) for s in share)
    behind = sum(r["longest"] for r in usable)
    horizon = next((v for v in ends if reached(v) - behind >= budget), ends[-1] if ends else 0.0)
    plan = [
        (r["source"], share[r["source"]], int(min(r["max_repeat"], -(-share[r["source"]] * horizon // r["available_tokens"]))), max(1, int(-(-r["n_docs"] // STRETCH))))
        for r in usable
    ]
    spark = sizes.sparkSession
    passes = F.broadcast(spark.createDataFrame(plan, "source string, share double, passes int, stretches int"))
    queue = (
        docs.join(passes, "source").where("passes > 0")
        .withColumn("copy", F.explode(F.expr("sequence(1, passes)")))
        .withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed)))
        .withColumn("stretch", F.least(F.floor((F.col("place") / 2.0**64 + 0.5) * F.col("stretches")), F.col("stretches") - 1).cast("int"))
    )
    by = ["source", "copy", "stretch"]
    w = Window.partitionBy("source").orderBy("copy", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = queue.groupBy(*by).agg(F.sum("n_tokens").alias("t")).select(*by, F.coalesce(F.sum("t").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*by).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = queue.withColumn("cum", F.sum("n_tokens").over(inside)).join(base, by).withColumn("finish", (F.col("cum") + F.col("base")) / F.col("share"))
    # the range sort: the queue passes tokens at an even pace, so equal spans of time are equal ranges; their totals run on from range to range
    ranges = max(1, int(sum(r["n_docs"] * p[2] for r, p in zip(usable, plan, strict=True)) // STRETCH))
    ranged = cut(
        timed.where(F.col("finish") <= horizon * (1 + 1e-12)).select("source", "doc_id", "copy", "n_tokens", "finish")
        .withColumn("range", F.least(F.floor(F.col("finish") * (ranges / max(horizon, 1e-300))), F.lit(ranges - 1)).cast("int"))
    )
    totals = ranged.groupBy("range").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("range", F.coalesce(F.sum("t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per range
    line = Window.partitionBy("range").orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    mixture = (
        ranged.join(before, "range").withColumn("upto", F.col("before") + F.sum("n_tokens").over(line))
        .where(F.col("upto") <= budget).select("source", "doc_id", "copy", "n_tokens", "finish")
    )

    used = mixture.groupBy("source").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    shares = (
        per.join(asked, per["source"].eqNullSafe(asked["source"]), "full")
        .select(F.coalesce(per["source"], asked["source"]).alias("source"), "weight", "max_repeat", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"))
        .join(passes.select("source", F.col("share").alias("target_share")), "source", "left")
        .join(used, "source", "left")
        .withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))).withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))
        .withColumn("target_share", F.coalesce("target_share", F.lit(0.0)))
    )
    all_ = F.sum("n_tokens").over(Window.partitionBy())  # one row per source
    shares = shares.withColumn("actual_share", F.when(all_ > 0, F.col("n_tokens") / all_).otherwise(0.0)).withColumn(
        "exhausted", (F.col("target_share") > 0) & (F.col("n_tokens") >= F.col("available_tokens") * F.col("max_repeat"))
    )
    order = ["source", "weight", "max_repeat", "target_share", "available_tokens", "n_uses", "n_tokens", "actual_share", "exhausted"]
    return mixture.orderBy("finish", "source", "doc_id", "copy"), shares.select(*order)
