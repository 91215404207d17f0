"""Plan shaping helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Filters on a projected column are pushed below the projection with its whole expression
    substituted, so a heavy parse would be planned and run once per filter. A generator output
    stops that substitution; ``inline`` over a one-element array adds no rows and no shuffle.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))).alias(*cols))
