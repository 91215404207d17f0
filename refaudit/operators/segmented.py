"""Ordered look-back over keys of any size.

A plain window puts all rows of one key into one task. Here rows are ordered inside
(key, minute) only, and what a minute hands on is a single row; the carry-over runs over
those rows, one per minute in use, so a key holding a third of the log is spread over all its minutes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def look_back(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: str = "minute", strict: bool = True,
              ts: str = "ts", segment: Column | None = None) -> DataFrame:
    """Add ``name``: the latest non-NULL ``value`` of the key before the row (``strict``) or up to it.

    ``segment`` replaces the time bucket by another column that never falls along ``order``.
    """
    rows = df.withColumn("_b", F.date_trunc(bucket, F.col(ts)) if segment is None else segment).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    last = rows.groupBy(*keys, "_b").agg(F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_b", F.last("_l", ignorenulls=True).over(before).alias("_carry"))
    return rows.join(carry, [*keys, "_b"]).withColumn(name, F.coalesce("_in", "_carry")).drop("_b", "_v", "_in", "_carry")
