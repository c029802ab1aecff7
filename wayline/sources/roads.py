"""Road types, map tables and road tables: reading, filtering, writing, caching."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tag, value, class id, priority, maximum speed (km/h).
ROAD_TYPES = [
    ("highway", "motorway", 101, 0.9, 130), ("highway", "motorway_link", 102, 1.1, 80), ("highway", "motorway_junction", 103, 1.1, 80),
    ("highway", "trunk", 104, 1.1, 120), ("highway", "trunk_link", 105, 1.2, 80), ("highway", "primary", 106, 1.2, 110),
    ("highway", "primary_link", 107, 1.3, 80), ("highway", "secondary", 108, 1.4, 80), ("highway", "secondary_link", 109, 1.5, 60),
    ("highway", "tertiary", 110, 1.6, 60), ("highway", "tertiary_link", 111, 1.7, 40), ("highway", "residential", 112, 2.5, 50),
    ("highway", "living_street", 113, 3.0, 20), ("highway", "service", 114, 5.0, 50), ("highway", "road", 115, 5.0, 50),
    ("highway", "unclassified", 117, 3.0, 50),
]
TYPES_DDL = "tag string, name string, class_id short, priority double, maxspeed int"

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
BASE_ROAD = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("source", T.LongType()), T.StructField("target", T.LongType()), T.StructField("refid", T.LongType()),
        T.StructField("oneway", T.BooleanType()), T.StructField("type", T.ShortType()), T.StructField("priority", T.DoubleType()),
        T.StructField("maxspeed_forward", T.DoubleType()), T.StructField("maxspeed_backward", T.DoubleType()), T.StructField("length", T.DoubleType()),
        T.StructField("coords", T.ArrayType(POINT)),
    ]
)


def road_types(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(tag, name, class_id, priority, maxspeed) from a JSON file {"tags": [{"tag", "values": [{"name", "id", "priority", "maxspeed"}]}]}, or the built-in list."""
    if path is None:
        return spark.createDataFrame(ROAD_TYPES, TYPES_DDL)
    schema = "tags array<struct<tag string, values array<struct<name string, id string, priority string, maxspeed string>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return (
        raw.select(F.explode("tags").alias("t")).select(F.col("t.tag").alias("tag"), F.explode("t.values").alias("v"))
        .select("tag", F.col("v.name").alias("name"), F.col("v.id").cast("short").alias("class_id"), F.col("v.priority").cast("double").alias("priority"), F.col("v.maxspeed").cast("int").alias("maxspeed"))
    )


def road_types_json(rows: list[tuple]) -> str:
    """The JSON text of a list of road types."""
    tags: dict[str, list] = {}
    for tag, name, k, priority, speed in rows:
        tags.setdefault(tag, []).append({"name": name, "id": k, "priority": priority, "maxspeed": speed})
    return json.dumps({"tags": [{"tag": t, "values": v} for t, v in tags.items()]})


def read_roads(
    spark: SparkSession, path: str | None = None, jdbc: dict | None = None, types: DataFrame | None = None, exclude: list[int] | None = None, polygon: list[tuple[float, float]] | None = None
) -> DataFrame:
    """Base roads from Parquet (``path``) or a database table (``jdbc``: options url, dbtable, user, password, fetchsize ...), filtered.

    With ``types``, roads of an unknown class are dropped, the priority comes from the types, and a null maximum speed becomes that
    of the class. ``exclude`` drops class ids; both predicates reach the scan. ``polygon`` keeps roads that lie in it with all vertices.
    """
    roads = spark.read.format("jdbc").options(**({"fetchsize": "10000"} | jdbc)).load() if jdbc else spark.read.parquet(path)
    return filter_roads(roads, types, exclude, polygon)


def filter_roads(roads: DataFrame, types: DataFrame | None = None, exclude: list[int] | None = None, polygon: list[tuple[float, float]] | None = None) -> DataFrame:
    """The filters of ``read_roads`` on a table of base roads."""
    if exclude:
        roads = roads.where(~F.col("type").isin(*exclude))
    if polygon:
        from wayline.operators.geo import coords_in_polygon

        roads = roads.where(coords_in_polygon(F.col("coords"), polygon))
    if types is not None:
        t = F.broadcast(types.select(F.col("class_id").alias("type"), F.col("priority").alias("t_priority"), "maxspeed").dropDuplicates(["type"]))  # one row per class: a 16-bit id
        roads = roads.join(t, "type").withColumns(
            {
                "priority": F.col("t_priority"),
                "maxspeed_forward": F.coalesce("maxspeed_forward", F.col("maxspeed").cast("double")),
                "maxspeed_backward": F.coalesce("maxspeed_backward", F.col("maxspeed").cast("double")),
            }
        ).drop("t_priority", "maxspeed")
    return roads.select(*(f.name for f in BASE_ROAD))


def write_roads(roads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write base roads as Parquet; mode append or overwrite."""
    roads.write.mode(mode).parquet(path)


def cached_roads(spark: SparkSession, path: str, build) -> DataFrame:
    """Read-through cache: the table at ``path``, built and written first if it is not there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        write_roads(build(), path)
    return spark.read.parquet(path)


def base_of(roads: DataFrame) -> DataFrame:
    """Base roads of a directed road table: its forward roads."""
    return roads.where("id % 2 = 0")


@dataclass(frozen=True)
class Settings:
    """Parameters of server, matcher and tracker with their defaults; ``of`` reads key=value lines."""

    sigma: float = 10.0
    lam: float = 0.0
    max_radius: float = 200.0
    max_distance: float = 15000.0
    interval_min: int = 1000
    distance_min: float = 0.0
    shorten_turns: bool = True
    state_ttl: int = 60
    monitor_sensitive: float = 0.0

    @staticmethod
    def of(text: str) -> Settings:
        keys = {
            "matcher.sigma": ("sigma", float), "matcher.lambda": ("lam", float), "matcher.radius.max": ("max_radius", float), "matcher.distance.max": ("max_distance", float),
            "matcher.interval.min": ("interval_min", int), "matcher.distance.min": ("distance_min", float), "tracker.state.ttl": ("state_ttl", int), "tracker.monitor.sensitive": ("monitor_sensitive", float),
        }
        got = {}
        for line in text.splitlines():
            k, eq, v = line.partition("=")
            if eq and not line.lstrip().startswith("#") and k.strip() in keys:
                name, kind = keys[k.strip()]
                got[name] = kind(v.strip())
        return Settings(**got)


def oneway_flag(reverse: Column) -> Column:
    """One-way unless the stored reverse cost is not negative."""
    return ~F.coalesce(reverse >= 0, F.lit(False))
