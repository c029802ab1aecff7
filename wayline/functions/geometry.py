"""Column expressions for points: tolerant WKT parsing, longitude normalisation, great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the sphere on which distances are great-circle metres.
EARTH_RADIUS_M = 6371008.8

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: WKT points with optional SRID prefix and Z/M values, any case and spacing; group 1 holds lon and lat.
POINT_PATTERN = (
    rf"(?i)^\s*(?:SRID\s*=\s*\d+\s*;\s*)?POINT\s*(?:ZM|Z|M)?\s*\(\s*({_NUMBER}\s+{_NUMBER})(?:\s+{_NUMBER}){{0,2}}\s*\)\s*$"
)


def normal_lon(lon: Column) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def point(wkt: Column) -> Column:
    """struct(lon, lat) of a WKT point; null for null, empty, malformed, non-finite or out-of-range points."""
    # each step binds its value by a lambda, so that the pattern is applied once
    pair = F.array(F.split(F.regexp_extract(wkt, POINT_PATTERN, 1), r"\s+"))
    number = lambda p, k: F.get(p, k).try_cast("double")
    xy = F.transform(pair, lambda p: F.struct(number(p, F.lit(0)).alias("x"), number(p, F.lit(1)).alias("y")))
    ok = lambda p: p["x"].isNotNull() & p["y"].between(-90.0, 90.0) & (F.abs(p["x"]) < 1e6)
    made = F.transform(xy, lambda p: F.when(ok(p), F.struct(normal_lon(p["x"]).alias("lon"), p["y"].alias("lat"))))
    return F.get(made, F.lit(0))


def located(df: DataFrame, wkt: str) -> DataFrame:
    """Adds lon and lat of a column of WKT points; rows without a point (see ``point``) are dropped.

    Generators bind the values in place of lambdas, whose plans are never found alike: so two uses of the result can read one exchange.
    """
    bind = lambda x, **c: x.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in c.items())))))
    x = bind(df, __p=F.split(F.regexp_extract(F.col(wkt), POINT_PATTERN, 1), r"\s+"))
    x = bind(x, __x=F.get("__p", F.lit(0)).try_cast("double"), __y=F.get("__p", F.lit(1)).try_cast("double"))
    x = x.where(F.col("__x").isNotNull() & F.col("__y").between(-90.0, 90.0) & (F.abs("__x") < 1e6))
    return x.select(*(c for c in df.columns), normal_lon(F.col("__x")).alias("lon"), F.col("__y").alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; longitudes count modulo 360."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
