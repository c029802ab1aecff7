"""Session helpers: shared checkpoint folder, size-checked broadcast, lookups that survive hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a lookup table that is ever broadcast.
BROADCAST_ROWS = 100_000


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Where none is named, a temporary one does for a local session; a cluster needs one that all
    its machines see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder: set it to one that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that it is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(facts: DataFrame, table: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of facts with a table that is unique by ``key``.

    The table is broadcast only after its row count was checked against ``rows``. Beyond that the join shuffles, with the
    facts salted 16-fold, by a hash of the row, against hot keys and the table repeated once per salt.
    """
    if small_enough(table.select(key), rows):
        return facts.join(F.broadcast(table), key, "left")
    salts = 16
    spread = facts.withColumn("__salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "__salt"], "left").drop("__salt")


def made(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, which keeps the optimizer from pasting their expressions into every later use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
