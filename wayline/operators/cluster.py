"""Density clustering: of numbers, of cyclic numbers, and of points on the globe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.roadmap import components
from wayline.operators.search import within
from wayline.session import cut

#: Number of ranges along the line in which windows run.
BUCKETS = 64


def cluster_line(values: DataFrame, eps: float, least: int) -> DataFrame:
    """Clusters of numbers: (x, n, cluster), one row per distinct value; noise is dropped.

    A value is a core if at least ``least`` values lie in [x - eps, x + eps], itself included and repeated ones counted; cores at most eps apart
    belong together; other values within eps of a core join the nearest core (ties: the lower). A cluster is named by its smallest core. Nulls and NaN do not count.

    RANGE frames count neighbours inside ranges of the line that see eps beyond their rims; a running count of gaps names the clusters per range, and the gaps
    of earlier ranges are added, so that no window holds all values.
    """
    one = values.where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    ends = one.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    width = max(4 * eps, ((ends["b"] or 0.0) - (ends["a"] or 0.0)) / BUCKETS, 1e-300)
    at = lambda c: F.floor(c / width)
    spread = lambda df: df.withColumn("home", at(F.col("x"))).withColumn("r", F.explode(F.array_distinct(F.array(at(F.col("x") - eps), F.col("home"), at(F.col("x") + eps)))))
    w = Window.partitionBy("r").orderBy("x")
    # frames of fractional width are written in SQL
    frame = lambda e, low, high: F.expr(f"{e} over (partition by r order by x range between {low} and {high})")
    down, up = f"{eps!r}D preceding", f"{eps!r}D following"
    counted = spread(one).withColumn("near", frame("sum(n)", down, up)).where("r = home").select("x", "n", "near")
    core = counted.where(F.col("near") >= least).select("x", at(F.col("x")).alias("r"))
    # a core begins a cluster if the core before it is more than eps away; the last core of the ranges before is looked up
    lasts = core.groupBy("r").agg(F.max("x").alias("top"))
    before = lasts.select("r", F.max("top").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # at most some dozens of ranges
    begun = core.join(F.broadcast(before), "r").withColumn("prev", F.coalesce(F.lag("x").over(w), F.col("before")))
    begun = begun.withColumn("begin", F.when(F.col("prev").isNull() | (F.col("x") - F.col("prev") > eps), F.col("x")))
    named = begun.withColumn("own", F.max("begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = named.groupBy("r").agg(F.max("begin").alias("top"))
    carried = tops.select("r", F.max("top").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    cores = named.join(F.broadcast(carried), "r").select("x", F.coalesce("own", "carried").alias("cluster"))
    rest = counted.where(F.col("near") < least)
    both = spread(cores.select("x", "cluster", F.lit(1).alias("is_core"), F.lit(0).cast("long").alias("n")).unionByName(rest.select("x", F.lit(None).cast("double").alias("cluster"), F.lit(0).alias("is_core"), "n")))
    both = both.withColumn("mine", F.when(F.col("is_core") == 1, F.struct("x", "cluster")))
    border = both.withColumn("low", frame("last(mine, true)", down, "current row")).withColumn("high", frame("first(mine, true)", "current row", up)).where("r = home and is_core = 0 and (low is not null or high is not null)")
    pick = F.when(F.col("high").isNull() | (F.col("x") - F.col("low.x") <= F.col("high.x") - F.col("x")), F.col("low.cluster")).otherwise(F.col("high.cluster"))
    joined = border.select("x", "n", pick.alias("cluster"))
    return cores.join(counted.select("x", "n"), "x").select("x", "n", "cluster").unionByName(joined)


def cluster_ring(values: DataFrame, modulo: float, eps: float, least: int) -> DataFrame:
    """Clusters of numbers on a ring: (x, n, cluster), x in [0, modulo); as ``cluster_line``, with eps at most half the ring.

    The ring is unrolled: copies of the values within 2 eps of the seam are put beyond either end, clustered on the line, and clusters that share a value through their
    copies are one. A cluster is named by the smallest name it has on the line.
    """
    eps = min(eps, modulo / 2)
    base = values.where("x is not null and not isnan(x)").select(F.pmod(F.col("x"), F.lit(float(modulo))).alias("x"))
    base = base.select(F.when(F.col("x") >= modulo - 1e-10, F.lit(0.0)).otherwise(F.col("x")).alias("x"))
    wide = base.select(F.explode(F.array_compact(F.array(F.col("x"), F.when(F.col("x") <= 2 * eps, F.col("x") + modulo), F.when(F.col("x") >= modulo - 2 * eps, F.col("x") - modulo)))).alias("x"))
    line = cut(cluster_line(wide, eps + 1e-10, least))
    pm = F.pmod(F.col("x"), F.lit(float(modulo)))
    x = F.round(F.when(pm >= modulo - 1e-9, F.lit(0.0)).otherwise(pm), 9)
    inside = line.where(F.col("x").between(-1e-10, modulo - 1e-10)).select(x.alias("k"), "x", "n", "cluster")
    copies = line.where(~F.col("x").between(-1e-10, modulo - 1e-10)).select(x.alias("k"), F.col("cluster").alias("other"))
    # clusters of the line that are one on the ring: at most the two at the seam and their copies
    pairs = inside.join(copies, "k").select("cluster", "other").distinct().collect()
    parent: dict[float, float] = {}

    def root(v: float) -> float:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    names = [(v, root(v)) for v in parent]
    if names:
        n = line.sparkSession.createDataFrame(names, "cluster double, name double")
        inside = inside.join(F.broadcast(n), "cluster", "left").withColumn("cluster", F.coalesce("name", "cluster"))
    return inside.select("x", "n", "cluster")


def ring_bounds(clusters: DataFrame, modulo: float, eps: float, buffer: float = 0.0) -> DataFrame:
    """(cluster, low, high): the arc of each cluster on the ring, widened by ``buffer``; both null where it covers the ring.

    The arc begins after the widest gap between neighbouring values, if that is wider than eps (ties: the first gap); low > high where it passes 0.
    """
    w = Window.partitionBy("cluster").orderBy("x")
    own = Window.partitionBy("cluster")
    x = clusters.select("cluster", "x", F.lead("x").over(w).alias("next"), F.min("x").over(own).alias("least"))
    gap = F.when(F.col("next").isNull(), F.col("least") + modulo - F.col("x")).otherwise(F.col("next") - F.col("x"))
    gap = F.max(F.struct(gap.alias("gap"), (-F.col("x")).alias("order"), "x", F.coalesce("next", "least").alias("next"))).alias("g")
    best = x.groupBy("cluster").agg(gap)
    open_ = (F.col("g.gap") > eps + 1e-10) & (F.col("g.gap") > 2 * buffer)
    m = F.lit(float(modulo))
    return best.select("cluster", F.when(open_, F.pmod(F.col("g.next") - buffer, m)).alias("low"), F.when(open_, F.pmod(F.col("g.x") + buffer, m)).alias("high"))


def ring_density(values: DataFrame, modulo: float, eps: float, buffer: float = 0.0, most: int = 62) -> DataFrame:
    """Step function of density on the ring: (x, density), each from x to the next x; it begins at x = 0. No values: (0, 0).

    Clusters are sought for least = 1, 2, 4, 8 ... until there are none; the density of a place is the greatest least of a cluster whose arc covers it.
    """
    spark = values.sparkSession
    arcs = None
    for k in range(most):  # powers of two up to the number of values: a logarithm of rounds
        b = cut(ring_bounds(cluster_ring(values, modulo, eps, 2**k), modulo, eps, buffer).select("low", "high", F.lit(2**k).cast("long").alias("density")))
        if b.isEmpty():
            break
        arcs = b if arcs is None else arcs.unionByName(b)
    if arcs is None:
        return spark.createDataFrame([(0.0, 0)], "x double, density long")
    m = F.lit(float(modulo))
    whole = F.col("low").isNull()
    parts = F.when(whole, F.array(F.struct(F.lit(0.0).alias("a"), m.alias("b")))).when(F.col("low") <= F.col("high"), F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")))).otherwise(
        F.array(F.struct(F.lit(0.0).alias("a"), F.col("high").alias("b")), F.struct(F.col("low").alias("a"), m.alias("b")))
    )
    p = arcs.select("density", F.explode(parts).alias("p")).select("density", "p.a", "p.b")
    # arcs of one level are disjoint: levels open at a place are counted by running sums of starts and ends, per level
    marks = p.select("density", F.col("a").alias("x"), F.lit(1).alias("d")).unionByName(p.select("density", F.col("b").alias("x"), F.lit(-1).alias("d"))).groupBy("density", "x").agg(F.sum("d").alias("d"))
    xs = p.select(F.col("a").alias("x")).union(p.select("b")).union(spark.createDataFrame([(0.0,)], "x double")).distinct().where(F.col("x") < modulo)
    grid = xs.crossJoin(F.broadcast(arcs.select("density").distinct()))  # every step against the few levels (a logarithm of the values)
    state = grid.join(marks, ["density", "x"], "left").withColumn("open", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("density").orderBy("x")))
    steps = state.groupBy("x").agg(F.coalesce(F.max(F.when(F.col("open") > 0, F.col("density"))), F.lit(0).cast("long")).alias("density"))
    # arcs of one place have no width: a step up and one down at the same x
    tips = p.where("a = b").groupBy(F.col("a").alias("x")).agg(F.max("density").alias("tip"))
    steps = steps.join(tips, "x", "left").withColumn("tip", F.when(F.col("tip") > F.col("density"), F.col("tip")))
    v = Window.orderBy("x")  # the steps of one ring
    kept = steps.withColumn("before", F.lag("density").over(v)).where("before is null or before <> density or tip is not null")
    return kept.select("x", F.explode(F.array_compact(F.array("tip", "density"))).alias("density"))


def cluster_points(points: DataFrame, eps_m: float, least: int) -> DataFrame:
    """Clusters of points on the globe: (lon, lat, cluster), one row per distinct place; noise is dropped.

    A place is a core if at least ``least`` places lie less than eps (strictly) away, itself included; cores less than eps apart hang together, and the
    others within eps of a core join the cluster of the nearest (ties: the smaller name). A cluster is named by its smallest place number. Places: distinct
    coordinates, numbered by a hash of them.
    """
    places = points.where("lon is not null and lat is not null").select("lon", "lat").distinct().withColumn("key", F.xxhash64("lon", "lat"))
    places = cut(places)
    near = cut(within(places, places, eps_m))
    core = near.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("key")
    links = near.join(core, "key").join(core.select(F.col("key").alias("target")), "target").where(F.col("key") <= F.col("target"))
    edges = links.select(F.xxhash64("key", "target").alias("id"), F.col("key").alias("source"), "target")
    groups = components(edges)
    named = edges.join(groups, "id").select(F.col("source").alias("key"), "component").distinct()
    named = cut(named.unionByName(edges.join(groups, "id").select(F.col("target").alias("key"), "component")).distinct())
    borders = near.join(core, "key", "left_anti").join(named.select(F.col("key").alias("target"), "component"), "target")
    borders = borders.groupBy("key").agg(F.min(F.struct("distance", "component"))["component"].alias("component"))
    return places.join(named.unionByName(borders), "key").select("lon", "lat", F.col("component").alias("cluster"))
