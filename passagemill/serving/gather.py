"""Articles for a project's papers, from the publisher or the layout parser."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import project as projects
from passagemill.operators import ingestion
from passagemill.sources import readers, remote
from passagemill.sources.stores import StampedTable


@dataclass(frozen=True)
class Connectors:
    publisher: remote.Connector = field(default_factory=remote.Publisher)
    layout: remote.Connector = field(default_factory=remote.LayoutParser)


def gather(spark: SparkSession, at: projects.Project, rows: DataFrame, files: DataFrame, connectors: Connectors) -> DataFrame:
    """(source_file, source, content) of the articles that could be had for marked manifest ``rows``; ``files`` has (source_file, text)."""
    nothing = F.lit(None).cast("binary").alias("content")
    articles = remote.fetch(rows.filter("route = 'jats'").select(F.col("pmcid").alias("id"), nothing), remote.outcomes(spark, at.table("fetched/publisher")), connectors.publisher)
    articles = articles.filter("content IS NOT NULL").select(F.col("id").alias("pmcid"), "content")
    pdfs = readers.read_bytes(spark, str(at.papers), "*.pdf")
    first = rows.select(F.col("source_file").alias("duplicate_of"), F.col("pdf_file").alias("b"))
    copies = rows.join(first, "duplicate_of").select("source_file", F.col("pdf_file").alias("a"), "b").filter("a IS NOT NULL AND b IS NOT NULL")
    same = copies.join(ingestion.same_files(copies.select("a", "b").distinct(), pdfs), ["a", "b"], "left_semi").select("source_file")
    pages = files.select("source_file", readers.page_count(F.coalesce("text", F.lit(""))).alias("pages"))
    wanted = ingestion.wanted_sources(rows, pages, same, articles.select("pmcid")).join(rows.select("source_file", "pmcid", "pdf_file"), "source_file")
    sent = wanted.filter("tei").join(pdfs.withColumnRenamed("name", "pdf_file"), "pdf_file")
    read = remote.fetch(sent.select(F.col("pdf_file").alias("id"), "content"), remote.outcomes(spark, at.table("fetched/layout")), connectors.layout)
    read = read.filter("content IS NOT NULL").select(F.col("id").alias("pdf_file"), "content")
    by_publisher = wanted.filter("jats").join(articles, "pmcid").select("source_file", F.lit("jats").alias("source"), "content")
    # Stored, so that what follows plans on one scan and not on all these joins.
    found = StampedTable(spark, at.table("fetched/articles"), "source_file string, source string, content binary")
    found.replace(by_publisher.unionByName(wanted.filter("tei").join(read, "pdf_file").select("source_file", F.lit("grobid").alias("source"), "content")))
    return found.read()
