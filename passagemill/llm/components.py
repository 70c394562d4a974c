"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges never leave the cluster: each round replaces every edge by one that is
closer to its component's smallest node, so a round's table is no larger than
the input, and the number of rounds grows with the logarithm of the nodes. A
node with very many edges is no task of its own: its least neighbour is found
with map-side combination and sent to its edges by ``join_skewed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.scratch import forget, materialize, recording, release
from passagemill.llm.skew import BROADCAST_ROWS, join_skewed


def _large_star(links: DataFrame, broadcast_rows: int) -> DataFrame:
    """Each node's larger neighbours become neighbours of its least one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    moved = join_skewed(both, least, "u", broadcast_rows=broadcast_rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _small_star(down: DataFrame, broadcast_rows: int) -> DataFrame:
    """Each node's smaller neighbours, and itself, become neighbours of its least one."""
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    others = join_skewed(down, least, "u", broadcast_rows=broadcast_rows).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(others).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's least node.

    Loops and repeated edges are harmless; null ends are dropped; no edges give
    an empty result. Tables of earlier rounds are deleted.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    links, before = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"), None
    for _ in range(max_rounds):
        with recording() as inner:
            down = materialize(_large_star(links, broadcast_rows), "cc-large")
            small = _small_star(down, broadcast_rows)
        after = materialize(small, "cc")
        release(spark, inner)
        forget(spark, links)
        links = after
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
