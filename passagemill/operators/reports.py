"""Reports: one row per kind and one over all, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as T

ALL = "all"


def _named(column: str) -> Column:
    # A kind that is null is a group of its own, not the row over all.
    return F.when(F.grouping(column) == 1, F.lit(ALL)).otherwise(F.col(column)).alias("kind")


def _share(condition: Column) -> Column:
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 9)


def _rollup(rows: DataFrame, kind: str, *values: Column) -> DataFrame:
    names = [f"v{n}" for n in range(len(values))]
    found = rows.rollup(kind).agg(_named(kind), *(v.alias(n) for v, n in zip(values, names, strict=True)))
    return found.drop(kind).toDF("kind", *names)


def ingest_report(papers: DataFrame) -> DataFrame:
    """(kind, papers, sections, paragraphs, references, citing, with_doi) per source and over all.

    papers has source, sections (number), paragraphs (number), citing (number of
    paragraphs that cite), references (number) and dois (number of references
    with one). Sections, paragraphs and references are medians.
    """
    shares = [F.round(F.sum(part) / F.greatest(F.sum(whole), F.lit(1)), 9) for part, whole in (("citing", "paragraphs"), ("dois", "references"))]
    found = _rollup(papers, "source", F.count("*"), F.median("sections"), F.median("paragraphs"), F.median("references"), *shares)
    return found.toDF("kind", "papers", "sections", "paragraphs", "references", "citing", "with_doi")


def chunk_report(chunks: DataFrame, kind: str = "kind", least: int = 150, most: int = 400) -> DataFrame:
    """(kind, chunks, median_words, within, short, long) per kind and over all: shares of passages between the bounds, under and over them."""
    words = chunks.select(kind, T.word_count(F.coalesce("text", F.lit(""))).alias("n"))
    found = _rollup(words, kind, F.count("*"), F.median("n"), _share(F.col("n").between(least, most)), _share(F.col("n") < least), _share(F.col("n") > most))
    return found.toDF("kind", "chunks", "median_words", "within", "short", "long")


def notes_report(notes: DataFrame, chunks: DataFrame, short: int = 50) -> DataFrame:
    """(passages, notes, empty, median_words, short): passages, notes with text and without, median length, share under ``short`` words."""
    with_text = chunks.select("note").distinct()
    empty = notes.select("note").distinct().join(with_text, "note", "left_anti").agg(F.count("*").alias("empty"))
    words = chunks.select("note", T.word_count(F.col("text")).alias("n"))
    counts = words.agg(F.count("*").alias("passages"), F.count_distinct("note").alias("notes"), F.median("n").alias("median_words"), _share(F.col("n") < short).alias("short"))
    return counts.crossJoin(empty)
