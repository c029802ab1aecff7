"""Runs of repeated events and their edge cases."""

import numpy as np
from pyspark.sql import functions as F

from wayline.llm.runs import position_runs


def test_runs(spark):
    p = lambda m: f"POINT({10 + m / 111195.08 / np.cos(np.radians(0)):.9f} 0.0)"
    rows = [("a", 1, p(0)), ("a", 2, p(2)), ("a", 3, p(4)), ("a", 4, None), ("a", 5, p(4)), ("a", 6, p(8)), ("a", 7, p(8.5)), ("a", 7, p(8.5)), ("a", 7, None), ("b", 1023, p(0)), ("b", 1024, p(1)), ("b", 5000, p(2)), (None, 1, p(0)), ("c", None, p(0)), ("c", 1, "POINT EMPTY"), ("c", 2, "")]
    df = spark.createDataFrame(rows, "id string, seq int, geom string").withColumn("run", F.lit(1))
    got = {(r.id, r.first_seq, r.last_seq, r.n_events) for r in position_runs(df).collect()}
    assert got == {("a", 1, 3, 3), ("a", 6, 7, 2), ("b", 1023, 5000, 3)}
    assert position_runs(df.limit(0)).count() == 0


def test_runs_blocks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [("a", int(k), f"POINT({179.99999 + rng.integers(0, 3) * 1e-5:.6f} 10)") for k in range(200)] + [("a", 201, "SRID=4326;POINT Z (-180.0 10 3)"), ("a", 202, "point( 1.8e2  1.0e1 )")]
    df = spark.createDataFrame(rows, "id string, seq int, geom string")
    a = {tuple(r) for r in position_runs(df, block=1024).collect()}
    assert a == {tuple(r) for r in position_runs(df, block=7).collect()} and a
