"""Positions and running totals inside groups of any size, without one task per group.

A window over a group that holds a third of all rows would sort those rows in
one task. Here each group is cut into hash buckets, bucket totals (at most
groups x buckets rows) give every bucket its start, and only rows of one
bucket are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    order: Sequence[str],
    name: str = "before",
    buckets: int = 4096,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come earlier.

    The order is by hash of ``order`` and then by ``order``: fixed for given
    rows, independent of partitioning. ``keys`` must not be null. Rows equal in
    every ``order`` column are interchangeable, so which of them comes first
    does not matter.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_value", value)
    by = [*keys, "_slice"]
    totals = sliced.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(starts, by)
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_slice", "_value", "_start")
    )
