"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step works on what the step before could not tell apart: only rows of a
length that recurs have their prefix hashed, and only rows whose length and
prefix both recur have their whole text hashed. Hot groups of equal texts are
decided by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.scratch import materialize
from passagemill.llm.skew import BROADCAST_ROWS, HOT_ROWS, join_skewed
from passagemill.partitions import spread

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 128
_ADDED = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    # A single space is left alone: the pattern matches only what changes.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, stages: dict[str, int] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size and kept.

    Texts are equal when they agree after ``normalised``; null equals empty.
    Of equal texts the row with the smallest id stays; a null id is larger than
    any other. Among rows that share both text and that smallest id exactly one
    is kept. Columns of ``docs`` named like the three added ones are replaced;
    any other names are safe. Texts of any length are read whole; equality of
    full texts is that of their SHA-256. An empty table gives an empty result.
    ``stages`` receives the rows, those with a prefix hashed and those hashed
    in full.
    """
    own = [c for c in docs.columns if c.lower() not in _ADDED]
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("length", F.length("text"))
    lengths = materialize(base.groupBy("length").agg(F.count("*").alias("rows")).filter("rows > 1").select("length"), "dedup-lengths")
    options = {"broadcast_rows": broadcast_rows, "hot_rows": hot_rows}
    recurring = join_skewed(base, lengths, "length", "left_semi", **options)
    prefix = F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix")
    pairs = materialize(recurring.select("length", prefix).groupBy("length", "prefix").agg(F.count("*").alias("rows")).filter("rows > 1").select("length", "prefix"), "dedup-pairs")
    # Rows of other lengths, or whose prefix is unique at their length, are alone.
    signed = base.select("*", prefix)
    alone = join_skewed(signed, pairs, ["length", "prefix"], "left_anti", **options).select("row", "id")
    again = join_skewed(signed, pairs, ["length", "prefix"], "left_semi", **options)
    again = materialize(again.select("row", "id", F.unhex(F.sha2("text", 256)).alias("full"), F.monotonically_increasing_id().alias("number")), "dedup-survivors")
    if stages is not None:
        stages |= {"rows": base.count(), "prefix": recurring.count(), "full": again.count()}

    # Nulls last: (is null, id, row) orders ids first and settles rows that share one.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("number").alias("number"))).alias("first")
    groups = materialize(again.groupBy("full").agg(first, F.count("*").alias("size")), "dedup-groups")
    decided = join_skewed(again, groups, "full", **options).select(
        "row", F.col("first.id").alias("keep_id"), F.col("size").cast("long").alias("group_size"), (F.col("number") == F.col("first.number")).alias("kept")
    )
    single = alone.select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return single.unionByName(decided).select("row.*", *_ADDED)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    hashed = docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return exact_dedup(hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
