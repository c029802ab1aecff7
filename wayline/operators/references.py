"""References to records that do not exist, were deleted, or came later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.times import utc_micros

#: Aimed number of parent keys in a range and of references in a batch.
RANGE_KEYS = 16_384
#: Ranges of a table, at most; beyond, each takes its keys in several parts.
MOST_RANGES = 2048
BATCH_REFS = 100_000


def _parents(versions: DataFrame, table: str) -> DataFrame:
    """One row per id: whether its highest version is deleted, and its earliest time. Ties of version: deleted counts."""
    order = F.struct(F.coalesce(F.col("version").cast("long"), F.lit(-(2**62))).alias("v"), F.coalesce(~F.col("visible"), F.lit(False)).alias("gone"))
    return (
        versions.where("id is not null")
        .groupBy(F.col("id").cast("long").alias("key"))
        .agg(F.max(order)["gone"].alias("gone"), F.min(utc_micros(versions, "tstamp")).alias("since"))
        .withColumn("ref_table", F.lit(table))
    )


def _probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Binary search of a batch of references in the sorted parent keys of its range; keeps the misses."""
    parents = parents.sort_values("key", kind="stable")
    keys = parents["key"].to_numpy(np.int64)
    want = refs["key"].to_numpy(np.int64)
    at = np.searchsorted(keys, want)
    inside = np.minimum(at, max(len(keys) - 1, 0))
    there = (at < len(keys)) & (keys[inside] == want) if len(keys) else np.zeros(len(want), bool)
    reason = np.where(there, "", "missing").astype(object)
    if len(keys):
        gone = parents["gone"].to_numpy(bool)[inside]
        since = parents["since"].to_numpy(np.float64)[inside]  # NaN: no time known, never later
        exact = pd.to_numeric(refs["us"]).to_numpy(np.float64)
        with np.errstate(invalid="ignore"):
            late = since > exact
        reason[there & late] = "later"
        reason[there & gone] = "deleted"
    out = refs[["ref_table", "key", "us"]].copy()
    out["owner"], out["pos"] = refs["owner"], refs["pos"]
    out["reason"] = reason
    return out[reason != ""]


def orphan_references(way_nodes: DataFrame, nodes: DataFrame, ways: DataFrame, range_keys: int = RANGE_KEYS, batch_refs: int = BATCH_REFS) -> DataFrame:
    """Broken references of way_nodes: (ref_table, way_id, sequence_id, key, reason, load_us), one row per reference.

    ``reason``: missing (no row has the id), deleted (its highest version is not visible), later (its earliest tstamp is after
    the tstamp of the referring row; if repeated rows differ, the earliest of them counts). Null references are no case; a
    null tstamp on either side is never later. Empty parents make every reference missing; no references give no row.

    Keys are range-partitioned at quantiles of the parents' own keys, so that ranges hold about ``range_keys`` of them however they cluster
    (of more than MOST_RANGES ranges' worth, each range is parted by a hash of the key). A range holds its parents as a sorted array, and is probed by
    batches of at most about ``batch_refs`` references by binary search. A hot range is split into several batches with a copy of its parents each.
    """
    raw = way_nodes.select(F.col("way_id").alias("owner"), F.col("sequence_id").alias("pos"), F.col("node_id").cast("long").alias("n"), utc_micros(way_nodes, "tstamp").alias("us"))
    refs = (
        raw.groupBy("owner", "pos", "n").agg(F.min("us").alias("us"))
        .select("owner", "pos", "us", F.explode(F.array(
            F.struct(F.lit("nodes").alias("ref_table"), F.col("n").alias("key")),
            F.struct(F.lit("ways").alias("ref_table"), F.col("owner").cast("long").alias("key")))).alias("r"))
        .select("r.ref_table", "r.key", "owner", "pos", "us").where("key is not null").distinct()
    )
    parents = _parents(nodes, "nodes").unionByName(_parents(ways, "ways"))
    # one row per table; only the key columns are read
    ids = nodes.select(F.lit("nodes").alias("ref_table"), F.col("id").cast("long").alias("key")).unionByName(ways.select(F.lit("ways").alias("ref_table"), F.col("id").cast("long").alias("key")))
    limits: dict[str, np.ndarray] = {}
    splits: dict[str, int] = {}
    for r in ids.where("key is not null").groupBy("ref_table").agg(F.count("*").alias("n"), F.percentile_approx("key", [k / MOST_RANGES for k in range(1, MOST_RANGES)], 10_000).alias("q")).collect():
        ranges = min(MOST_RANGES, -(-r["n"] // range_keys))
        limits[r["ref_table"]] = np.unique(np.array(r["q"], np.int64)[np.arange(1, ranges) * MOST_RANGES // ranges - 1])
        splits[r["ref_table"]] = -(-r["n"] // (range_keys * MOST_RANGES))

    def ranged(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                name, key = np.array(b.column("ref_table").to_pylist(), object), b.column("key").to_numpy()
                at = np.zeros(len(b), np.int32)
                for k, v in limits.items():
                    at[name == k] = np.searchsorted(v, key[name == k], side="right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "range"])

        parts = F.when(F.col("ref_table") == "nodes", F.lit(splits.get("nodes", 1))).otherwise(F.lit(splits.get("ways", 1)))
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", range int"
        return df.mapInArrow(run, ddl).withColumn("split", F.pmod(F.xxhash64("key"), parts).cast("int"))

    refs = ranged(refs)
    group = ["ref_table", "range", "split"]
    salts = refs.groupBy(*group).agg(F.ceil(F.count("*") / batch_refs).cast("int").alias("salts"))
    batches = refs.join(salts, group).withColumn("salt", F.pmod(F.xxhash64("owner", "pos"), F.col("salts")).cast("int"))
    copies = ranged(parents).join(salts, group).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    by = [*group, "salt"]
    owner, pos = way_nodes.schema["way_id"].dataType.simpleString(), way_nodes.schema["sequence_id"].dataType.simpleString()
    found = (
        batches.drop("salts").groupBy(*by).cogroup(copies.groupBy(*by))
        .applyInPandas(_probe, f"ref_table string, key long, us long, owner {owner}, pos {pos}, reason string")
    )
    return found.select("ref_table", F.col("owner").alias("way_id"), F.col("pos").alias("sequence_id"), "key", "reason", F.col("us").alias("load_us"))


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Counts of broken references per table, reason and load period: (ref_table, period, reason, n_refs). Unknown load time: null period."""
    return orphans.groupBy("ref_table", F.date_format(F.date_trunc(period, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("load_us") / 86_400_000_000).cast("int"))), "yyyy-MM-dd").alias("period"), "reason").agg(F.count("*").alias("n_refs"))
