"""From files to papers: manifest rows, parsed texts, the copy that stays, and which paper a file holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import linkage
from passagemill.sources import articles, readers

#: Files with more pages are not sent to the layout parser.
MAX_PAGES = 100
# Fixed values: "<authors> <year> - <title>" as a file name, and marks of supplementary material in it.
_FILE_NAME = r"^(.+?)(?: (\d{4}))? - (.+)$"
_SUPPLEMENT = r"(?i)suppl|moesm|_esm"


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def best_title(meta: Column, name: Column) -> Column:
    """The title of a matched record, else of the file name, else of the heading, else the name itself."""
    matched = F.when(meta["Matched PubMed record"] == "yes", F.nullif(meta["Title"], F.lit("")))
    return F.coalesce(matched, F.nullif(F.regexp_extract(name, _FILE_NAME, 3), F.lit("")), meta["Title"], name)


def file_year(meta: Column, name: Column) -> Column:
    return F.coalesce(F.when(meta["Year"].rlike(r"^\d{4}$"), meta["Year"]), F.nullif(F.regexp_extract(name, _FILE_NAME, 2), F.lit(""))).cast("int")


def manifest(files: DataFrame, pdfs: DataFrame, entries: DataFrame, overrides: DataFrame, not_citable: list[str]) -> DataFrame:
    """One row per (source_file, text): identifiers, key and how it was found, citability and route.

    pdfs has (pdf_file), entries (key, doi, title, cited, pos) with normalised
    titles, overrides (source_file, key). An override counts only if the key is
    an entry's. Of a file's candidate titles the first that an entry has wins.
    """
    name = stem(F.col("source_file"))
    read = files.select("source_file", name.alias("stem"), readers.metadata(F.coalesce("text", F.lit(""))).alias("meta"))
    meta = F.col("meta")
    titles = F.array(best_title(meta, F.col("stem")), meta["Title"], F.regexp_extract("stem", _FILE_NAME, 3))
    rows = read.withColumn("_title", titles[0]).withColumn("_doi", T.normalise_doi(meta["DOI"]))
    asked = rows.select("source_file", F.posexplode(titles).alias("n", "_raw")).select("source_file", "n", T.normalise_title(F.col("_raw")).alias("title")).filter("title <> ''")
    by_doi = rows.select("source_file", F.col("_doi").alias("doi")).join(linkage.pick(entries, "doi"), "doi").select("source_file", F.col("key").alias("_doi_key"))
    exact = asked.join(linkage.pick(entries, "title"), "title").groupBy("source_file").agg(F.min_by("key", "n").alias("_title_key"))
    found = rows.join(by_doi, "source_file", "left").join(exact, "source_file", "left")
    unknown = found.filter("_doi_key IS NULL AND _title_key IS NULL").select("source_file")
    similar = linkage.similar_titles(asked.join(unknown, "source_file", "left_semi").select(F.struct("source_file", "n").alias("record"), "title"), entries)
    similar = similar.groupBy(F.col("record.source_file").alias("source_file")).agg(F.min_by("key", "record.n").alias("_similar_key"))
    corrected = overrides.join(entries.select("key").distinct(), "key", "left_semi").select("source_file", F.col("key").alias("_override"))
    found = found.join(similar, "source_file", "left").join(corrected, "source_file", "left").join(pdfs.select(stem(F.col("pdf_file")).alias("stem"), "pdf_file"), "stem", "left")

    sources = {"override": "_override", "doi": "_doi_key", "title": "_title_key", "similar title": "_similar_key"}
    key = F.coalesce(*sources.values())
    how = F.coalesce(*(F.when(F.col(c).isNotNull(), label) for label, c in sources.items()))
    supplement, pmcid = F.col("source_file").rlike(_SUPPLEMENT), F.upper(meta["PMCID"])
    return found.select(
        F.when(key.isNull(), F.col("stem")).otherwise(F.concat(key, F.when(supplement, "-supplement").otherwise(""))).alias("paper_id"),
        key.alias("key"), how.alias("matched_by"), (key.isNotNull() & ~F.col("source_file").isin(not_citable)).alias("citable"),
        F.when(pmcid.isNotNull() & ~supplement, "jats").otherwise("grobid").alias("route"), "source_file", "pdf_file", supplement.alias("supplement"),
        F.when(supplement, F.concat("_title", F.lit(" (supplementary material)"))).otherwise(F.col("_title")).alias("title"),
        file_year(meta, F.col("stem")).alias("year"), F.col("_doi").alias("doi"), meta["PMID"].alias("pmid"), pmcid.alias("pmcid"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Manifest rows with duplicate_of; a duplicate's id is its file stem."""
    found = linkage.mark_duplicates(rows)
    return found.withColumn("paper_id", F.when(F.col("duplicate_of").isNull(), F.col("paper_id")).otherwise(stem(F.col("source_file"))))


def papers(rows: DataFrame, parsed: DataFrame, entries: DataFrame, not_citable: list[str]) -> DataFrame:
    """Marked manifest rows joined with parsed texts (source_file, source, title, ..., references).

    The manifest's identifiers come first. A paper without a key gets a second
    chance with the parsed DOI and title. Of late keys that meet an id in use,
    or each other, only the first in file order takes it; the rest keep theirs.
    """
    texts = parsed.select("source_file", "source", F.struct(*(c for c in parsed.columns if c not in ("source_file", "source"))).alias("p"))
    both = rows.join(texts, "source_file")
    asked = both.filter("key IS NULL AND duplicate_of IS NULL").select(F.col("source_file").alias("record"), T.normalise_doi(F.col("p.doi")).alias("doi"), T.normalise_title(F.col("p.title")).alias("title"))
    late = linkage.link_cascade(asked, entries).filter("key IS NOT NULL").select(F.col("record").alias("source_file"), F.col("key").alias("_late"))
    free = late.join(rows.select(F.col("paper_id").alias("_late")), "_late", "left_anti").groupBy("_late").agg(F.min("source_file").alias("source_file"))
    both = both.join(late, "source_file", "left").join(free.select("source_file", F.lit(True).alias("_takes")), "source_file", "left")
    publisher = (F.col("source") == "jats") & (F.col("p.title") != "")
    return both.select(
        F.when(F.col("_takes"), F.col("_late")).otherwise(F.col("paper_id")).alias("paper_id"), F.coalesce("key", "_late").alias("key"),
        F.when(F.col("_late").isNotNull(), ~F.col("source_file").isin(not_citable)).otherwise(F.col("citable")).alias("citable"),
        F.when(publisher, F.col("p.title")).otherwise(F.col("title")).alias("title"),
        *(F.coalesce(c, f"p.{c}").alias(c) for c in ("year", "doi", "pmid", "pmcid")),
        "source", "source_file", "duplicate_of", "p.abstract", "p.sections", "p.captions", "p.reference_ids", "p.references",
    )


def choose_source(jats: Column, tei: Column) -> Column:
    """struct(source, path): the publisher's article, else the layout parser's, else the Markdown itself."""
    return F.when(jats.isNotNull(), F.struct(F.lit("jats").alias("source"), jats.alias("path"))).when(tei.isNotNull(), F.struct(F.lit("grobid").alias("source"), tei.alias("path"))).otherwise(
        F.struct(F.lit("markdown").alias("source"), F.lit(None).cast("string").alias("path"))
    )


def fallback_reason(pdf_file: Column, pages: Column, failure: Column) -> Column:
    """Why a paper is read from its Markdown."""
    return (
        F.when(pdf_file.isNull(), "no PDF")
        .when(pages > MAX_PAGES, F.concat(pages.cast("string"), F.lit(f" pages, more than {MAX_PAGES}")))
        .when(failure.isNotNull(), F.concat(F.lit("layout parser: "), F.substring(F.trim(failure), 1, 120)))
        .otherwise("layout parser not run")
    )


def file_papers(rows: DataFrame) -> DataFrame:
    """(source_file, paper): a file's paper; a duplicate without a key has its first copy's."""
    first = rows.select(F.col("source_file").alias("duplicate_of"), F.coalesce("key", "paper_id").alias("_first"))
    return rows.join(first, "duplicate_of", "left").select("source_file", F.coalesce("key", "_first", "paper_id").alias("paper"))


def same_files(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of file names whose contents are byte for byte equal; files has (name, content)."""
    hashed = files.select("name", F.length("content").alias("size"), F.sha2("content", 256).alias("hash"))
    left, right = (hashed.select(F.col("name").alias(n), F.col("size").alias(f"_size_{n}"), F.col("hash").alias(f"_hash_{n}")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.filter((F.col("_size_a") == F.col("_size_b")) & (F.col("_hash_a") == F.col("_hash_b"))).select("a", "b")


def wanted_sources(rows: DataFrame, pages: DataFrame, same_pdf: DataFrame, jats_there: DataFrame) -> DataFrame:
    """(source_file, jats, tei): which files are to be read as articles.

    rows are marked manifest rows, pages has (source_file, pages), same_pdf
    (source_file) copies with their first copy's PDF, jats_there (pmcid) what
    the publisher gives. A copy is read only where it can make a difference:
    not if the kept copy has an article, nor if the PDFs are equal. The layout
    parser takes what has a PDF, no article, and not too many pages.
    """
    article = F.col("route") == "jats"
    found = rows.join(jats_there.select("pmcid").distinct().withColumn("_there", F.lit(True)), "pmcid", "left").withColumn("jats", article & F.coalesce("_there", F.lit(False)))
    first = found.select(F.col("source_file").alias("duplicate_of"), F.col("jats").alias("_first"))
    found = found.join(first, "duplicate_of", "left").join(same_pdf.select("source_file").distinct().withColumn("_same", F.lit(True)), "source_file", "left").join(pages, "source_file", "left")
    layout = ~F.col("jats") & F.col("pdf_file").isNotNull() & (F.coalesce("pages", F.lit(0)) <= MAX_PAGES) & ~F.coalesce("_first", F.lit(False)) & F.col("_same").isNull()
    return found.select("source_file", "jats", layout.alias("tei"))


def parse_sources(chosen: DataFrame) -> DataFrame:
    """Parsed texts of (source_file, source, content, text): articles by their format, Markdown by its pages; an article without any text is read from the Markdown."""
    read = None
    for form, source in (("jats", "jats"), ("tei", "grobid")):
        parsed = articles.parse_articles(chosen.filter(F.col("source") == source), form).withColumn("source", F.lit(source))
        read = parsed if read is None else read.unionByName(parsed)
    empty = (F.size("sections") == 0) & (F.coalesce("abstract", F.lit("")) == "")
    whole = read.filter(~empty)
    rest = chosen.join(whole.select("source_file"), "source_file", "left_anti").select("source_file", "text")
    return whole.unionByName(readers.parse_markdown(rest).withColumn("source", F.lit("markdown")))
