"""Samples: JSON requests, messages, replay; and the last-value sink."""

from __future__ import annotations

import time as clock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.geometry import point

SAMPLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("time_ms", T.LongType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("azimuth", T.DoubleType())])
MESSAGE = "id string, time string, point string, azimuth double"


def normal_azimuth(azimuth: Column) -> Column:
    """Azimuth in [0, 360); null for null, NaN and infinite."""
    return F.when(azimuth.isNotNull() & ~F.isnan(azimuth) & (F.abs(azimuth) < float("inf")), F.pmod(azimuth, F.lit(360.0)))


def time_ms(text: Column) -> Column:
    """Milliseconds of a number of milliseconds or of 'yyyy-MM-dd HH:mm:ssX' with any offset notation; else null."""
    stamp = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    return F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("long")).otherwise(F.unix_millis(stamp))


def samples_from_json(messages: DataFrame, column: str = "body") -> DataFrame:
    """Samples (SAMPLE) of JSON objects {id, time, point, azimuth}; rows that are no such object, or lack id, time or point, are dropped."""
    m = F.from_json(column, MESSAGE)
    x = messages.select(m.alias("m")).select(F.col("m.id").alias("id"), time_ms(F.col("m.time")).alias("time_ms"), point(F.col("m.point")).alias("p"), normal_azimuth(F.col("m.azimuth")).alias("azimuth"))
    return x.where("id is not null and time_ms is not null and p is not null").select("id", "time_ms", "p.lon", "p.lat", "azimuth")


def samples_from_requests(requests: DataFrame, column: str = "body") -> DataFrame:
    """Samples of JSON requests: an array of samples or {"format": ..., "request": [...]}; adds format (null: the server's). Duplicate times are kept: see ``duplicate_times``."""
    item = f"struct<{', '.join(':'.join(c.split(' ')) for c in MESSAGE.split(', '))}>"
    whole = F.from_json(column, f"format string, request array<{item}>")
    plain = F.from_json(column, f"array<{item}>")
    x = requests.select(F.when(F.ltrim(F.col(column)).startswith("["), F.struct(F.lit(None).cast("string").alias("format"), plain.alias("request"))).otherwise(whole).alias("r"))
    x = x.select("r.format", F.explode("r.request").alias("m"))
    x = x.select("format", F.col("m.id").alias("id"), time_ms(F.col("m.time")).alias("time_ms"), point(F.col("m.point")).alias("p"), normal_azimuth(F.col("m.azimuth")).alias("azimuth"))
    return x.where("time_ms is not null and p is not null").select("format", "id", "time_ms", "p.lon", "p.lat", "azimuth")


def duplicate_times(samples: DataFrame) -> DataFrame:
    """(id, time_ms, n): times that occur more than once within an id, which a request must not have."""
    return samples.groupBy("id", "time_ms").agg(F.count("*").alias("n")).where("n > 1")


def filter_samples(samples: DataFrame, polygon: list[tuple[float, float]] | None = None, since_ms: int | None = None) -> DataFrame:
    """Samples from a time on and inside a polygon."""
    if since_ms is not None:
        samples = samples.where(F.col("time_ms") >= since_ms)
    if polygon:
        from wayline.operators.geo import in_polygon

        samples = samples.where(in_polygon(F.col("lon"), F.col("lat"), polygon))
    return samples


def replay(samples, speed: float = 1.0, sleep=clock.sleep, now=clock.monotonic):
    """Yields ordered samples (dicts with time_ms) at their recorded pace; an error where time runs backwards. A driver-side test feed."""
    start, first, last = now(), None, None
    for s in samples:
        t = s["time_ms"]
        if last is not None and t < last:
            raise ValueError(f"samples are not in order of time: {t} after {last}")
        first, last = t if first is None else first, t
        wait = (t - first) / 1000 / speed - (now() - start)
        if wait > 0:
            sleep(wait)
        yield s


def replay_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of samples (Parquet with SAMPLE), some files at a time."""
    return spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def last_values(updates: DataFrame, key: str = "id", time: str = "time_ms") -> DataFrame:
    """The newest update of each key (ties: the greatest); rows whose point is missing delete the key. Null keys and times are ignored."""
    x = updates.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rest = [c for c in x.columns if c not in (key, time)]
    newest = x.groupBy(key).agg(F.max(F.struct(F.col(time), *(F.col(c) for c in rest))).alias("__r")).select(key, "__r.*")
    return newest.where("lon is not null and lat is not null")
