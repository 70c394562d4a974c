"""Joins of many rows with a table that has one row per key, where a few keys may hold a large share of the rows.

A small table is broadcast. For a larger one only the keys that many rows share
are: fewer than BROADCAST_ROWS of them can exist above the chosen share. All
other rows meet the table in a shuffle in which no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.scratch import materialize

#: Rows of at most about 100 bytes that are broadcast.
BROADCAST_ROWS = 200_000
#: Rows from which a key is hot, at least.
HOT_ROWS = 1_000


def join_skewed(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``; both are read more than once and should be written tables.

    ``how`` is inner, left, left_semi or left_anti. ``table`` has no key twice.
    Null keys match nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), keys, how)
    least = max(hot_rows, rows.count() // max(1, broadcast_rows) + 1)
    hot = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= least).select(*keys), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(few, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(table, keys, how))
