"""Shard assignment by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The published generator ``key * 2862933555777941757 + 1 mod 2^64`` is carried
as two 32-bit halves, since SQL integers do not wrap under ANSI rules. One walk
of the jumps gives the shard for n and for n + 1 shards: the walk for n stops
at the first jump target >= n, and a row moves on growth only if that target is
exactly n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.ranks import running_total
from passagemill.partitions import spread

_MULTIPLIER = 2862933555777941757
_C_HI, _C_LO = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF
_MASK16, _MASK32 = 0xFFFF, 0xFFFFFFFF


def _low32_of_product(x: Column, c: int) -> Column:
    """x * c mod 2^32 for x, c < 2^32, with no intermediate above 2^49."""
    low, high = x.bitwiseAND(F.lit(_MASK16)), F.shiftrightunsigned(x, 16)
    return (low * F.lit(c) + F.shiftleft((high * F.lit(c)).bitwiseAND(F.lit(_MASK16)), 16)).bitwiseAND(F.lit(_MASK32))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    low, high = lo.bitwiseAND(F.lit(_MASK16)), F.shiftrightunsigned(lo, 16)
    upper = high * F.lit(_C_LO)
    sum_low = low * F.lit(_C_LO) + F.lit(1) + F.shiftleft(upper.bitwiseAND(F.lit(_MASK16)), 16)
    carry = F.shiftrightunsigned(sum_low, 32) + F.shiftrightunsigned(upper, 16)
    new_hi = (carry + _low32_of_product(hi, _C_LO) + _low32_of_product(lo, _C_HI)).bitwiseAND(F.lit(_MASK32))
    return new_hi, sum_low.bitwiseAND(F.lit(_MASK32))


def _walk(key: Column, shards: int, steps: int) -> Column:
    """struct(hi, lo, b, j) after at most ``steps`` jumps; finished once j >= shards."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_MASK32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(state: Column, _: Column) -> Column:
        hi, lo = _advance(state["hi"], state["lo"])
        target = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), target.cast("long").alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard) for a 64-bit ``key``.

    A walk takes about ln(shards) jumps. The short walk covers nearly all rows;
    a row that needs more takes the full walk of at most ``shards`` jumps, so
    the result is exact for every key. A null key is hashed as key 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    short = min(shards, 16 + 2 * shards.bit_length())

    def ends(state: Column) -> Column:
        return F.struct(state["b"].cast("int").alias("shard"), F.when(state["j"] == shards, F.lit(shards)).otherwise(state["b"]).cast("int").alias("grown_shard"))

    walked = F.transform(F.array(_walk(key, shards, short)), lambda s: F.when(s["j"] >= shards, ends(s)).otherwise(ends(_walk(key, shards, shards)) if short < shards else ends(s)))
    return walked[0]


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Key law: the hash of the id and the shard count decide, so repeated ids
    share a shard. Texts of any length count whole. Null text has size 16 and the CRC of an empty text; a null
    id hashes like any other value; an empty table gives an empty result. Other
    columns of ``docs`` are ignored. Slots number each shard's rows 0, 1, 2 ...
    in an order that depends on the rows alone.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shards(F.xxhash64(F.col(id_col)), shards).alias("_placed"),
    )
    placed = slim.select("doc_id", "size", "text_crc32", "law", "_placed.shard", "_placed.grown_shard")
    slotted = running_total(placed, ["shard"], F.lit(1), ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_shard_documents(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), 40)
