"""Ingestion and the query interface on made-up rows."""

import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import evaluation, ingestion, ranking
from passagemill.serving import cli, library, report

PAPER = "# Heading here.\n- Matched PubMed record: yes\n- Year: 2011\n- DOI: 10.5555/OWL\n- PMCID: pmc7\n## Extracted Full Text\n## Page 1\nOwls."


def test_manifest_and_papers(spark):
    files = spark.createDataFrame([("Ash 2010 - Owls.md", PAPER), ("Elm 2012 - A study of the voles of the marsh.md", "text"), ("Fir SUPPL.md", "- DOI: 10.5555/owl\n"), ("odd.md", None), ("later.md", "x")], "source_file string, text string")
    pdfs = spark.createDataFrame([("odd.pdf",)], "pdf_file string")
    entries = spark.createDataFrame([("owl", "10.5555/owl", "owls", False, 0), ("vole", None, "a study of the voles of a marsh", True, 1), ("late", "10.5555/late", "late words", False, 2)], "key string, doi string, title string, cited boolean, pos int")
    overrides = spark.createDataFrame([("odd.md", "missing"), ("Elm 2012 - A study of the voles of the marsh.md", "vole")], "source_file string, key string")
    rows = ingestion.marked(ingestion.manifest(files, pdfs, entries, overrides.limit(1), ["odd.md"]))
    found = {r.source_file: r for r in rows.collect()}
    owls, voles, more, odd = (found[f] for f in ("Ash 2010 - Owls.md", "Elm 2012 - A study of the voles of the marsh.md", "Fir SUPPL.md", "odd.md"))
    assert (owls.paper_id, owls.matched_by, owls.title, owls.year, owls.route, owls.pmcid) == ("owl", "doi", "Heading here", 2011, "jats", "PMC7")
    assert (voles.key, voles.matched_by, voles.year, voles.route) == ("vole", "similar title", 2012, "grobid")
    assert (more.paper_id, more.supplement, more.title) == ("owl-supplement", True, "Fir SUPPL (supplementary material)")
    assert (odd.key, odd.citable, odd.paper_id, odd.pdf_file) == (None, False, "odd", "odd.pdf")
    text = "source_file string, source string, title string, year int, doi string, pmid string, pmcid string, abstract string, sections array<string>, captions array<string>, reference_ids array<string>, references map<string,string>"
    parsed = spark.createDataFrame([("later.md", "jats", "Any", 2001, "10.5555/late", "5", None, "", [], [], [], {}), ("odd.md", "grobid", "Odd", 2002, None, None, None, "", [], [], [], {})], text)
    papers = {r.source_file: r for r in ingestion.papers(rows, parsed, entries, []).collect()}
    assert (papers["later.md"].paper_id, papers["later.md"].citable, papers["later.md"].title, papers["later.md"].year) == ("late", True, "Any", 2001)
    assert (papers["odd.md"].paper_id, papers["odd.md"].title, papers["odd.md"].doi) == ("odd", "odd", None)


def test_file_papers_and_reasons(spark):
    rows = spark.createDataFrame([("a", "k", "k", None), ("b", None, "b", "a"), ("c", None, "c", None)], "source_file string, key string, paper_id string, duplicate_of string")
    assert {r.source_file: r.paper for r in ingestion.file_papers(rows).collect()} == {"a": "k", "b": "k", "c": "c"}
    why = spark.createDataFrame([(None, 1, None), ("p", 101, None), ("p", 1, " bad "), ("p", 1, None)], "pdf string, pages int, failure string")
    assert [r.w for r in why.select(ingestion.fallback_reason(F.col("pdf"), F.col("pages"), F.col("failure")).alias("w")).collect()] == ["no PDF", "101 pages, more than 100", "layout parser: bad", "layout parser not run"]


@pytest.fixture(scope="module")
def collection(spark):
    rows = [(n, f"c{n}", "d" if n < 4 else "e", "T", "S", text, n != 1) for n, text in enumerate(["owls hunt <voles>", "voles & owls owls", "moss", "peat", "ferns", "pines", "oaks", "elms"])]
    chunks = spark.createDataFrame(rows, "pos long, chunk_id string, document string, title string, section string, text string, citable boolean")
    vectors = chunks.select("pos", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))
    return library.Collection("made up", chunks.withColumn("index_text", F.col("text")), {"dense": (vectors, lambda q: [0.0, 1.0])})


def test_search(spark, collection):
    hits = library.search(collection, "Owls", 5, ["bm25"]).collect()
    assert [h.chunk_id for h in hits] == ["c1", "c0"] and hits[0].ranks == {"bm25": 1}
    assert [h.chunk_id for h in library.search(collection, "owls", 5, ["bm25"], citable_only=True).collect()] == ["c0"]
    assert "fused" in library.search(collection, "owls", 1).first().ranks
    assert library.search(collection, "nothing here", 3, ["bm25"]).count() == 0
    for wrong in ({"k": 0}, {"k": 21}, {"methods": []}, {"methods": ["other"]}):
        with pytest.raises(ValueError):
            library.search(collection, "owls", **wrong)


def test_context(collection):
    assert [r.chunk_id for r in library.get_context([collection], "c3", 2).collect()] == ["c1", "c2", "c3"]
    with pytest.raises(library.UnknownChunk):
        library.get_context([collection], "none")


def test_report_and_cli(spark, collection, tmp_path, capsys):
    page = report.render(collection, [library.answer(collection, "owls amp", 2, methods=["bm25"]), library.answer(collection, "absent", 2, methods=["bm25"])])
    assert "voles &amp; <mark>owls</mark> <mark>owls</mark>" in page and "&lt;voles&gt;" in page and "No hits." in page
    assert report.write(page, str(tmp_path)) != report.write(page, str(tmp_path))
    collection.chunks.drop("index_text").write.parquet(str(tmp_path / "chunks"))
    cli.main([str(tmp_path / "chunks"), "owls", "--html", str(tmp_path / "pages")], spark)
    assert "voles & owls owls" in capsys.readouterr().out and list((tmp_path / "pages").iterdir())


def test_cached_scores_and_number_share(spark):
    pairs = spark.createDataFrame([("owl", "an owl"), ("owl", "an owl"), ("elm", "oak")], "query string, passage string")
    scores, news = ranking.cached_scores(pairs, spark.createDataFrame([], "pair_hash string, score double"))
    assert news.count() == 2 and sorted(r.score for r in scores.collect()) == [0.0, 1.0, 1.0]
    assert ranking.cached_scores(pairs, news)[1].count() == 0
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 9), (2, 10, 1)], "query_id long, pos long, rank long")
    chunks = spark.createDataFrame([(10, "p", "it had 5"), (11, "p", "and 7")], "pos long, paper string, text string")
    answers = spark.createDataFrame([(1, "p"), (2, "q")], "query_id long, paper string")
    asked = spark.createDataFrame([(1, ["5"]), (2, ["5"]), (3, [])], "query_id long, numbers array<string>")
    assert evaluation.number_share(found, chunks, answers, asked).first().asDict() == {"queries": 2, "share": 0.5}


def test_highlight_without_terms(spark):
    assert spark.range(1).select(T.highlight(F.lit("a < b"), []).alias("h")).first().h == "a &lt; b"
