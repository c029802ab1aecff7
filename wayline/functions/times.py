"""Instants as microseconds since 1970, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a column of times: times without zone count as UTC; whole numbers as microseconds; texts and others are cast."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind == "timestamp_ntz":
        second = (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + second
    return c if kind == "bigint" else F.unix_micros(c.cast("timestamp"))
