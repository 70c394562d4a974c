"""python -m passagemill.serving.build [ingest|chunk|index|check]: from a project's files to tables that can be searched."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import project as projects
from passagemill.functions import text as T
from passagemill.operators import chunking, ingestion, lexical, linkage, vectors
from passagemill.serving import checks, library
from passagemill.serving.gather import Connectors, gather
from passagemill.sources import articles, latex, readers, stores
from passagemill.sources.stores import StampedTable

STEPS = ("ingest", "chunk", "index", "check")
CHUNKS = {
    "library": "pos long, chunk_id string, document string, title string, section string, text string, key string, citable boolean, year int, doi string, source_file string, kind string, cites array<string>",
    "thesis": "pos long, chunk_id string, document string, title string, section string, text string, file string, line_start int, line_end int, kind string, keys array<string>, hash string",
    "notes": "pos long, chunk_id string, document string, title string, section string, text string, note string, file string, line_start int, line_end int, hash string",
}
MANIFEST = "paper_id string, key string, matched_by string, citable boolean, route string, source_file string, pdf_file string, supplement boolean, title string, year int, doi string, pmid string, pmcid string, duplicate_of string"
PAPERS = "paper_id string, key string, citable boolean, source string, source_file string, duplicate_of string, pmid string, pmcid string, " + articles.PARSED.replace(" pmid string, pmcid string,", "")


def manifest_table(spark: SparkSession, at: projects.Project) -> StampedTable:
    return StampedTable(spark, at.table("manifest"), MANIFEST)


def paper_table(spark: SparkSession, at: projects.Project) -> StampedTable:
    return StampedTable(spark, at.table("papers"), PAPERS)


def chunk_table(spark: SparkSession, at: projects.Project, name: str) -> StampedTable:
    return StampedTable(spark, at.table(f"chunks/{name}"), CHUNKS[name])


def _conformed(rows: DataFrame, schema: str) -> DataFrame:
    fields = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def ingest(spark: SparkSession, at: projects.Project, parsed: DataFrame | None = None, connectors: Connectors | None = None) -> dict[str, int]:
    """Read the project's papers into the manifest and the paper table; counts of papers, new files, copies and removed papers.

    ``parsed`` has (source_file, source, content) of articles at hand; else
    ``connectors``, if given, are asked for them. All other papers are read
    from their Markdown.
    """
    at.required()
    files = readers.read_texts(spark, str(at.papers))
    pdfs = spark.createDataFrame([(p.name,) for p in sorted(at.papers.glob("*.pdf"))], "pdf_file string")
    bib = readers.read_texts(spark, str(at.folder), at.bibliography.name) if at.bibliography.is_file() else spark.createDataFrame([], "text string")
    bbl = readers.read_texts(spark, str(at.folder), at.reference_list.name) if at.reference_list.is_file() else None
    entries = readers.bib_entries(bib, bbl)
    table = manifest_table(spark, at)
    seen = table.read().select("source_file")
    new = checks.waiting(files, seen).count()
    rows = _conformed(ingestion.marked(ingestion.manifest(files, pdfs, entries, readers.read_overrides(spark, str(at.overrides)), [])), MANIFEST)
    table.replace(rows)
    rows = table.read()
    if parsed is None and connectors is not None:
        parsed = gather(spark, at, rows, files, connectors)
    fetched = parsed if parsed is not None else spark.createDataFrame([], "source_file string, source string, content binary")
    chosen = files.join(fetched, "source_file", "left").withColumn("source", F.coalesce("source", F.lit("markdown")))
    every = ingestion.papers(rows, ingestion.parse_sources(chosen), entries, [])
    # The best copy of each group stays, under the identity of the first.
    counted = every.select(
        F.coalesce("duplicate_of", "source_file").alias("first"), "source_file", F.col("citable").cast("int").alias("citable"), "source", F.size(F.flatten(F.transform("sections", lambda s: s["paragraphs"]))).alias("paragraphs")
    )
    best = linkage.choose_copies(counted).select(F.col("first").alias("_first"), F.col("best").alias("source_file"))
    identity = every.filter("duplicate_of IS NULL").select(F.col("source_file").alias("_first"), F.col("paper_id").alias("_id"))
    kept = every.join(best, "source_file").join(identity, "_first").drop("paper_id", "_first").withColumnRenamed("_id", "paper_id")
    removed = stores.write_papers(paper_table(spark, at), _conformed(kept, PAPERS))
    return {"papers": paper_table(spark, at).read().count(), "new": new, "copies": rows.filter("duplicate_of IS NOT NULL").count(), "removed": removed}


def _note_rows(spark: SparkSession, at: projects.Project) -> DataFrame:
    """(note, file, source) of the vault's notes; the walk follows links, which a listing cannot, and Spark reads the files it names."""
    paths = readers.note_files(str(at.notes))
    if not paths:
        return spark.createDataFrame([], "note string, file string, source string")
    named = spark.createDataFrame([(Path(p).as_uri(), Path(p).relative_to(at.notes).with_suffix("").as_posix(), Path(p).relative_to(at.folder).as_posix()) for p in paths], "uri string, note string, file string")
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace(F.url_encode("path"), r"^file%3A(%2F)+", "").alias("_at"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
    return named.withColumn("_at", F.regexp_replace(F.url_encode(F.url_decode("uri")), r"^file%3A(%2F)+", "")).join(files, "_at").select("note", "file", "source")


def _positioned(chunks: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Add pos, gapless in reading order. Positions count ranges first, so that no task orders all rows; the ranges are written, as a lost one might be cut another way."""
    ranged = chunks.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    numbered.write.mode("overwrite").parquet(folder)
    numbered = chunks.sparkSession.read.parquet(folder)
    sizes, before = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}, {}
    total = 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offsets = chunks.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    return numbered.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def chunk(spark: SparkSession, at: projects.Project) -> dict[str, int]:
    """Cut every collection that the project has; the number of passages of each."""
    found = {}
    for name in at.collections:
        if name == "library":
            rows = chunking.chunk_papers(stores.read_papers(paper_table(spark, at)))
            rows = rows.withColumn("document", F.col("paper_id")).withColumn("cites", F.transform("cites", lambda c: c["text"]))
            order = ["document", "n"]
        elif name == "notes":
            rows, order = chunking.chunk_notes(_note_rows(spark, at)).withColumn("document", F.col("note")).withColumn("title", F.col("note")), ["document", "n"]
        else:
            names = latex.chapter_files(at.book_record.read_text(errors="replace"))
            texts = [(at.folder.name, n, f, (at.folder / f).read_text(errors="replace")) for n, f in enumerate(names) if (at.folder / f).is_file()]
            rows = latex.latex_passages(spark.createDataFrame(texts, "book string, pos long, file string, source string")).withColumn("document", F.split("section", " > ")[0])
            order = ["n"]
        found[name] = chunk_table(spark, at, name).replace(_conformed(_positioned(rows, order, at.table(f"numbering/{name}")), CHUNKS[name]))
    return found


def hashed(chunks: DataFrame) -> DataFrame:
    header = T.index_header(F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")))
    return chunks.select("pos", header.alias("header"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", T.text_hash(F.col("header"), F.col("text")))


def with_index_text(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("index_text", T.index_text(*(F.coalesce(c, F.lit("")) for c in ("title", "section", "text"))))


def index(spark: SparkSession, at: projects.Project, encoders: tuple[str, ...] = ("hashing",)) -> dict[tuple[str, str], tuple[int, int]]:
    """Bring postings and vectors of all collections and models up to date; (reused, embedded) texts of each."""
    counts = {}
    for name in at.collections:
        chunks = chunk_table(spark, at, name).read()
        lexical.write_index(lexical.build_index(with_index_text(chunks)), at.table(f"index/{name}"))
        for model in encoders:
            encoder = vectors.load_encoder(model)
            counts[name, model] = vectors.update(hashed(chunks), stores.vector_store(spark, str(at.store), name, model, encoder.settings), encoder)
    return counts


def open_collection(spark: SparkSession, at: projects.Project, name: str, encoders: tuple[str, ...] = ("hashing",)) -> library.Collection:
    """A stored collection; StaleIndex if a passage has no vector."""
    chunks = chunk_table(spark, at, name).read()
    made = {}
    for model in encoders:
        encoder = vectors.load_encoder(model)
        stored = stores.vector_store(spark, str(at.store), name, model, encoder.settings).read()
        made[model] = (vectors.load_vectors(hashed(chunks), stored), encoder.ask)
    return library.Collection(name, with_index_text(chunks), made, index=lexical.read_index(spark, at.table(f"index/{name}")))


def shelf(spark: SparkSession, at: projects.Project, encoders: tuple[str, ...] = ("hashing",)) -> library.Shelf:
    """The project's collections, loaded on first use and again after they have been built anew."""

    def version(name: str) -> str:
        tables = [chunk_table(spark, at, name), lexical.index_tables(spark, at.table(f"index/{name}"))["terms"]]
        tables += [stores.vector_store(spark, str(at.store), name, m, "") for m in encoders]
        return "|".join(str(t.version()) for t in tables)

    return library.Shelf(lambda name: open_collection(spark, at, name, encoders), version)


def readiness(spark: SparkSession, at: projects.Project, encoders: tuple[str, ...] = ("hashing",)) -> tuple[list[str], bool]:
    """Lines of the readiness report, and whether nothing required is missing."""

    def there() -> checks.Finding:
        at.required()
        return checks.Finding("project", True, str(at.folder))

    def papers() -> checks.Finding:
        table = manifest_table(spark, at)
        return checks.library(readers.read_texts(spark, str(at.papers)), table.read() if table.version() else None, paper_table(spark, at).read().count())

    def coverage() -> checks.Finding:
        return checks.index({name: (hashed(chunk_table(spark, at, name).read()), {m: stores.vector_store(spark, str(at.store), name, m, vectors.load_encoder(m).settings).read() for m in encoders}) for name in at.collections})

    return checks.report([there, lambda: checks.disk(str(at.folder)), papers, coverage])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("steps", nargs="*", choices=(*STEPS, []), default=[])
    parser.add_argument("--project", help="the project's folder")
    parser.add_argument("--fetch", action="store_true", help="ask the publisher and the layout parser for articles")
    options = parser.parse_args(arguments)
    at = projects.find(None if options.project is None else {projects.VARIABLE: options.project}).required()
    spark = spark or SparkSession.builder.appName("passagemill").getOrCreate()
    for step in options.steps or STEPS:
        if step == "check":
            lines, ready = readiness(spark, at)
            print("\n".join(lines))
            if not ready:
                raise SystemExit(1)
        else:
            more = {"connectors": Connectors()} if step == "ingest" and options.fetch else {}
            print(step, {"ingest": ingest, "chunk": chunk, "index": index}[step](spark, at, **more))


if __name__ == "__main__":
    main()
