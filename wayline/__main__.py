"""python -m wayline match SAMPLES BASE_ROADS OUT [--radius M] [--sigma M]: match Parquet samples on Parquet base roads."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    a = argparse.ArgumentParser(prog="wayline", description=__doc__)
    sub = a.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match", help="match traces (id, time_ms, lon, lat, azimuth) on base roads")
    m.add_argument("samples")
    m.add_argument("roads")
    m.add_argument("out")
    m.add_argument("--radius", type=float, default=200.0)
    m.add_argument("--sigma", type=float, default=10.0)
    m.add_argument("--interval", type=int, default=1000, help="least milliseconds between samples")
    m.add_argument("--format", choices=["rows", "slim", "geojson", "debug", "osm"], default="rows")
    o = a.parse_args()
    spark = SparkSession.builder.appName("wayline").getOrCreate()
    from wayline.operators import matcher, roadmap
    from wayline.sources.roads import filter_roads, read_roads, road_types

    base = filter_roads(read_roads(spark, o.roads), road_types(spark))
    roads = roadmap.split_roads(base)
    out = matcher.match(spark.read.parquet(o.samples), base, roads, matcher.Parameters(radius=o.radius, sigma=o.sigma), least_ms=o.interval)
    (out if o.format == "rows" else matcher.formatted(out, roads, o.format)).write.parquet(o.out)


if __name__ == "__main__":
    main()
