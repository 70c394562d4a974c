"""python -m passagemill.serving.cli CHUNKS.parquet QUESTION... : search a table of passages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import vectors
from passagemill.serving import library, report


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description="Search a table of passages (pos, chunk_id, document, title, section, text).")
    parser.add_argument("chunks")
    parser.add_argument("question", nargs="+")
    parser.add_argument("-k", type=int, default=10)
    parser.add_argument("--methods", nargs="+", help="bm25, or encoders by name; bm25 alone by default")
    parser.add_argument("--no-rerank", action="store_true")
    parser.add_argument("--words", type=int, default=30, help="words of each passage to print")
    parser.add_argument("--html", metavar="FOLDER", help="write a page there")
    options = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("passagemill").getOrCreate()
    rows = spark.read.parquet(options.chunks)
    chunks = rows.withColumn("index_text", T.index_text(F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))))
    made = {}
    for name in dict.fromkeys(m for m in options.methods or () if m != "bm25"):
        encoder = vectors.load_encoder(name)
        hashed = chunks.select("pos", T.index_header(F.coalesce("title", F.lit("")), F.coalesce("section", F.lit(""))).alias("header"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", T.text_hash(F.col("header"), F.col("text")))
        store = vectors.encode_missing(hashed, spark.createDataFrame([], "text_hash string, vector array<float>"), encoder.passage)
        made[name] = (hashed.select("pos", "text_hash").join(store, "text_hash").select("pos", "vector"), encoder.ask)
    collection = library.Collection("library", chunks, made)
    answers = [library.answer(collection, q, options.k, methods=options.methods, rerank=not options.no_rerank) for q in options.question]
    for found in answers:
        print(f"{found.question} ({found.seconds:.2f} s)")
        for hit in found.hits:
            words = (hit["text"] or "").split()
            print(f"{hit['rank']:3} {hit['score']:.3f} {report.label(hit)} {hit['section'] or ''}\n    {' '.join(words[: options.words])}{' ...' if len(words) > options.words else ''}")
    if options.html:
        print(report.write(report.render(collection, answers), options.html))


if __name__ == "__main__":
    main()
