"""Directed roads, topology, costs, paths and routes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.session import cut


def split_roads(base: DataFrame) -> DataFrame:
    """Directed roads of base roads: forward (id 2b), and backward (2b + 1, ends and geometry turned) unless one-way.

    (id, base_id, heading, source, target, refid, type, priority, maxspeed, length, coords); a null oneway counts as two-way.
    """
    x = base.withColumn("h", F.explode(F.when(F.coalesce("oneway", F.lit(False)), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    back = F.col("h") == 1
    return x.select(
        (F.col("id") * 2 + F.col("h")).alias("id"), F.col("id").alias("base_id"), F.when(back, "backward").otherwise("forward").alias("heading"),
        F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"),
        "refid", "type", "priority", F.when(back, F.col("maxspeed_backward")).otherwise(F.col("maxspeed_forward")).alias("maxspeed"), "length",
        F.when(back, F.reverse("coords")).otherwise(F.col("coords")).alias("coords"),
    )


def road_json(roads: DataFrame) -> DataFrame:
    """(id, json): {"road": base id, "heading": heading} of each directed road."""
    return roads.select("id", F.to_json(F.struct(F.col("base_id").alias("road"), "heading")).alias("json"))


def successors(edges: DataFrame) -> DataFrame:
    """(id, successor): edges that leave the target of an edge."""
    a, b = edges.select("id", F.col("target").alias("v")), edges.select(F.col("id").alias("successor"), F.col("source").alias("v"))
    return a.join(b, "v").select("id", "successor")


def cost_distance(length: Column, fraction: Column | float = 1.0) -> Column:
    return length * fraction


def cost_time(length: Column, maxspeed: Column, fraction: Column | float = 1.0) -> Column:
    """Seconds at the allowed speed, at most 130 km/h."""
    return length * F.lit(3.6) / F.least(maxspeed, F.lit(130.0)) * fraction


def cost_time_priority(length: Column, maxspeed: Column, priority: Column, fraction: Column | float = 1.0) -> Column:
    """Seconds times the road's priority, which counts as 1 at least."""
    return cost_time(length, maxspeed, fraction) * F.greatest(F.lit(1.0), priority)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): edges with equal component hang together through shared nodes; the component is named by its smallest node.

    Every node follows the smallest label among its neighbours, the nodes that bear a label follow the best of them (hooking), and labels are
    replaced by their own labels (jumping), so that the rounds grow with the logarithm of the number of nodes. Every round is written to the
    shared checkpoint folder; the loop ends when nothing changes. Edges with a null end are left out.
    """
    spark = edges.sparkSession
    clean = edges.where("source is not null and target is not null")
    links = cut(clean.select(F.col("source").alias("a"), F.col("target").alias("b")).union(clean.select("target", "source")).where("a <> b").distinct())
    nodes = clean.select(F.col("source").alias("v")).union(clean.select("target")).distinct()
    labels = cut(nodes.select("v", F.col("v").alias("l")))
    # derived predicates would double in number with every round
    setting = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        for _ in range(rounds):
            best = links.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
            near = labels.join(best, labels["v"] == best["a"], "left").select("v", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
            hook = near.groupBy("l").agg(F.min("n").alias("h"))
            hooked = cut(near.join(hook, "l").select("v", "l", F.least("n", "h").alias("n")))
            up = hooked.select(F.col("v").alias("n"), F.col("n").alias("up"))
            jumped = cut(hooked.join(up, "n").select("v", "l", F.least("n", "up").alias("new")))
            labels = jumped.select("v", F.col("new").alias("l"))
            if jumped.where("new <> l").isEmpty():
                break
        else:
            raise RuntimeError(f"components are not stable after {rounds} rounds")
        return clean.join(labels.select(F.col("v").alias("source"), F.col("l").alias("component")), "source").select("id", "component")
    finally:
        spark.conf.set(setting, before)


def path_costs(paths: DataFrame, edges: DataFrame, cost: Column) -> DataFrame:
    """(path_id, cost) of paths (path_id, edges array<long>, source_frac, target_frac): first edge from its fraction, last up to its, all between whole.

    ``cost`` is an expression over the columns of ``edges`` for a whole edge; paths with unknown edges have a null cost.
    """
    x = paths.select("path_id", "source_frac", "target_frac", F.posexplode("edges").alias("pos", "id"))
    x = x.join(edges.select("id", cost.alias("c")), "id", "left").withColumn("c", F.coalesce("c", F.lit(float("nan"))))
    n = F.max("pos")
    total = F.sum("c") - F.max(F.when(F.col("pos") == 0, F.col("c") * F.col("source_frac")))
    last = F.max_by("c", "pos") * (1 - F.max("target_frac"))
    return x.groupBy("path_id").agg(F.nanvl(total - last, F.lit(None).cast("double")).alias("cost"), (n + 1).alias("n_edges"))


def path_valid(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, valid): consecutive edges are successors, a path on one edge does not run backwards, and the edges are known and at least one."""
    x = paths.select("path_id", F.posexplode("edges").alias("pos", "id")).join(edges.select("id", "source", "target"), "id", "left")
    y = x.select("path_id", F.col("pos") + 1, F.col("target").alias("from")).toDF("path_id", "pos", "from")
    broken = x.join(y, ["path_id", "pos"], "left").groupBy("path_id").agg(F.max((F.col("source").isNull() | ((F.col("pos") > 0) & ~F.col("from").eqNullSafe(F.col("source")))).cast("int")).alias("bad"))
    back = (F.size("edges") == 1) & (F.col("source_frac") > F.col("target_frac"))
    return paths.join(broken, "path_id", "left").select("path_id", (F.coalesce(F.col("bad") == 0, F.lit(False)) & ~back).alias("valid"))


def path_concat(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """Joins paths of equal path_id: (path_id, edges, source_frac, target_frac, ok).

    On one and the same edge the end of the left must be the begin of the right; on neighbouring edges the left must end at 1 and the right begin
    at 0; otherwise ok is false and the left path stays as it is.
    """
    l, r = left.select("path_id", F.col("edges").alias("le"), F.col("source_frac").alias("ls"), F.col("target_frac").alias("lt")), right.select("path_id", F.col("edges").alias("re"), F.col("source_frac").alias("rs"), F.col("target_frac").alias("rt"))
    x = l.join(r, "path_id").withColumn("e1", F.element_at("le", -1)).withColumn("e2", F.col("re")[0])
    x = x.join(edges.select(F.col("id").alias("e1"), F.col("target").alias("t1")), "e1", "left").join(edges.select(F.col("id").alias("e2"), F.col("source").alias("s2")), "e2", "left")
    same = (F.col("e1") == F.col("e2")) & (F.col("lt") == F.col("rs"))
    next_ = (F.col("t1") == F.col("s2")) & (F.col("lt") == 1.0) & (F.col("rs") == 0.0) & (F.col("e1") != F.col("e2"))
    tail = F.slice("re", 2, F.greatest(F.size("re") - 1, F.lit(0)))
    ok = F.coalesce(same | next_, F.lit(False))
    return x.select(
        "path_id", F.when(F.coalesce(same, F.lit(False)), F.concat("le", tail)).when(F.coalesce(next_, F.lit(False)), F.concat("le", "re")).otherwise(F.col("le")).alias("edges"),
        F.col("ls").alias("source_frac"), F.when(ok, F.col("rt")).otherwise(F.col("lt")).alias("target_frac"), ok.alias("ok"),
    )
