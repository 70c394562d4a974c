"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage reads what its predecessor kept and its decisions take effect. All
stages but the last return the columns of ``documents``; the last returns the
packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import scratch
from passagemill.llm.exact_dedup import exact_dedup
from passagemill.llm.language import fit_language_model, held_out, identify_language
from passagemill.llm.mixing import mixed_documents
from passagemill.llm.ngram_join import ngram_jaccard_join
from passagemill.llm.packing import pack_documents

#: Keys of dropped near copies, about 50 bytes each, that may be broadcast; beyond, that join shuffles.
BROADCAST_ROWS = 500_000

_earlier: list[str] = []


def _stage(function):
    """Intermediate tables of a stage are deleted when a later stage starts: its own result is written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, _earlier)
        with scratch.recording() as paths:
            result = function(spark, docs, sf_dir)
        _earlier.extend(paths)
        return result

    run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
    return run_stage


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator adds, and the new name of each column."""
    names = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is named with a sufficient margin; those without a text or letter go.

    Rows are judged one by one: repeated rows alike, ties by name, texts whole;
    an empty table stays empty. Any further columns stay.
    """
    model = fit_language_model(docs, ~F.coalesce(held_out(), F.lit(True)))
    rows, names = _plain(docs)
    kept = identify_language(rows, model, text_col=names["text"]).filter(~F.col("rejected"))
    return kept.select(*names.values()).toDF(*docs.columns)


@_stage
def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts; null equals empty, of equal rows one stays.

    Texts are compared whole; an empty table stays empty. Any further columns
    stay.
    """
    rows, names = _plain(docs)
    kept = exact_dedup(rows, names["doc_id"], names["text"]).filter("kept")
    return kept.select(*names.values()).toDF(*docs.columns)


@_stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group connected by five-word shingle similarity of 0.8 or more.

    Rows that share an id are told apart by their texts; rows equal in both
    stay or go together. Documents without words stay. Texts are read whole; an
    empty table stays empty. Any further columns stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")).alias("key"))
    groups = ngram_jaccard_join(keyed.select("key", F.col("row.text").alias("text")), words=5, percent=80, id_col="key")
    gone = scratch.materialize(groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("key")).distinct(), "near-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, "key", "left_anti").select("row.*")


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the source targets ask.

    A document without words takes no place in the mix. Repeated rows are
    documents of their own; an empty table stays empty. Any further columns stay.
    """
    return mixed_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens; each pass of a document is packed. Other columns are left out."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", dedup_exact), ("ngram_jaccard_join", dedup_near), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Language ID, mixing order and packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{scratch.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", []
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return docs
        docs.write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        scratch.release(spark, before)
        before = [path]
    return docs
