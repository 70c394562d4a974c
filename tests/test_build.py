"""A project from its files to a search, and an evaluation run on it."""

import pytest
from pyspark.sql import functions as F

from passagemill import project as projects
from passagemill.operators import evalrun, ingestion, lexical, vectors
from passagemill.serving import build, library, report
from passagemill.sources import articles, readers, stores


def test_project_is_found(tmp_path):
    (tmp_path / "p" / "data" / "manuscripts").mkdir(parents=True)
    (tmp_path / "p" / "deep" / "er").mkdir(parents=True)
    assert projects.find({}, tmp_path / "p" / "deep" / "er").folder == (tmp_path / "p").resolve()
    assert projects.find({projects.VARIABLE: str(tmp_path / "p")}, tmp_path).required().collections == ("library",)
    with pytest.raises(FileNotFoundError):
        projects.find({}, tmp_path).required()


def test_stamped_table(spark, tmp_path):
    table = stores.StampedTable(spark, str(tmp_path / "t"), "paper_id string, n long", "a")
    assert table.read().count() == 0 and table.version() is None
    rows = spark.createDataFrame([("x", 1), ("y", 2)], table.schema)
    assert stores.write_papers(table, rows) == 0 and [r.paper_id for r in stores.read_papers(table).collect()] == ["x", "y"]
    first = table.version()
    assert stores.write_papers(table, rows.filter("n = 1")) == 1 and table.version() != first
    assert table.add(rows.filter("n = 2")) == 2 and table.read().count() == 2
    assert stores.StampedTable(spark, table.path, table.schema, "b").read().count() == 0
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2
    halved = stores.halved(spark.createDataFrame([([0.1, -3.14159, 0.0],)], "vector array<float>")).first()[0]
    import numpy as np

    assert halved == [float(np.float16(x)) for x in (0.1, -3.14159, 0.0)]


def test_stored_index_gives_the_same_ranking(spark, tmp_path):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(("virus in bats and birds", "virus", "birds", "soil", "rain virus virus"))], "pos long, index_text string")
    asked = spark.createDataFrame([(1, "virus virus birds"), (2, "nothing")], "query_id long, text string")
    index = lexical.write_index(lexical.build_index(chunks), str(tmp_path / "i"))
    wanted = {tuple(r) for r in lexical.bm25(chunks, asked).select("query_id", "pos", "score", "rank").collect()}
    assert wanted and {tuple(r) for r in lexical.bm25_stored(index, asked).select("query_id", "pos", "score", "rank").collect()} == wanted


def test_encoders():
    pair = vectors.load_encoder("hashing-pair")
    assert vectors.load_encoder("hashing") is vectors.load_encoder("hashing") and pair.settings != vectors.load_encoder("hashing").settings
    assert abs((pair.passage(["owl"], ["owl"])[0] ** 2).sum() ** 0.5 - 1.5) < 1e-9 and len(pair.ask("owl")) == 64
    with pytest.raises(ValueError):
        vectors.load_encoder("none")


def test_gathering(spark):
    kinds = "source_file string, route string, pmcid string, pdf_file string, duplicate_of string"
    rows = spark.createDataFrame([("a", "jats", "PMC1", "a.pdf", None), ("b", "jats", "PMC2", "b.pdf", None), ("c", "grobid", None, "c.pdf", "a"), ("d", "grobid", None, "d.pdf", "b"), ("e", "grobid", None, None, None), ("f", "grobid", None, "f.pdf", None), ("g", "grobid", None, "g.pdf", "b")], kinds)
    pages = spark.createDataFrame([("f", 101)], "source_file string, pages int")
    found = ingestion.wanted_sources(rows, pages, spark.createDataFrame([("d",)], "source_file string"), spark.createDataFrame([("PMC1",)], "pmcid string"))
    assert {r.source_file: (r.jats, r.tei) for r in found.collect()} == {"a": (True, False), "b": (False, True), "c": (False, False), "d": (False, False), "e": (False, False), "f": (False, False), "g": (False, True)}
    files = spark.createDataFrame([("x", b"1"), ("y", b"1"), ("z", b"2")], "name string, content binary")
    assert [tuple(r) for r in ingestion.same_files(spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string"), files).collect()] == [("x", "y")]


def test_markdown_is_parsed_in_compatibility_form(spark):
    files = spark.createDataFrame([("a.md", "x\n## Extracted Full Text\n## Page 1\nthe \ufb01rst\n## Page 2\n"), ("b.md", None)], "source_file string, text string")
    got = {r.source_file: r for r in readers.parse_markdown(files).collect()}
    assert [p["text"] for s in got["a.md"]["sections"] for p in s["paragraphs"]] == ["the first"] and got["b.md"]["sections"] == []


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    (folder / "data" / "manuscripts").mkdir(parents=True)
    (folder / "data" / "notes" / "sub dir").mkdir(parents=True)
    head = "# {0}\n- DOI: 10.1000/{1}\n## Extracted Full Text\n## Page 1\n{2}\n"
    for name, doi, text in (("Ash 2001 - Owls", "owl", "Owls hunt voles at night."), ("Elm 2002 - Moss", "moss", "Moss holds water in peat."), ("Elm 2002 - Moss again", "moss", "Moss holds water.")):
        (folder / "data" / "manuscripts" / f"{name}.md").write_text(head.format(name, doi, text))
    (folder / "allpapers.bib").write_text("@article{owl, title={Owls}, doi={10.1000/owl}}\n@article{moss, title={Moss}, doi={10.1000/moss}}")
    (folder / "data" / "notes" / "sub dir" / "day+1.md").write_text("# Owls\nHeard an owl.\n\nVoles?\n")
    (folder / "thesis.fls").write_text(f"INPUT chapters/one.tex\n")
    (folder / "chapters").mkdir()
    (folder / "chapters" / "one.tex").write_text("\\chapter{Birds}\nOwls hunt voles \\citep{owl}.\n\nMoss is wet \\citep{moss}.\n")
    return projects.find({projects.VARIABLE: str(folder)})


def test_build_and_search(spark, place, capsys):
    build.main(["--project", str(place.folder)], spark)
    told = capsys.readouterr().out
    assert "'papers': 2, 'new': 3, 'copies': 1, 'removed': 0" in told and "ok       project" in told and "missing" not in told.lower()
    papers = {r.paper_id: r for r in stores.read_papers(build.paper_table(spark, place)).collect()}
    assert set(papers) == {"owl", "moss"} and papers["moss"].source == "markdown"
    shelf = build.shelf(spark, place)
    held = shelf.get("library")
    assert shelf.get("library") is held
    top = library.search_library(held, "owls hunting voles", 2).collect()
    assert top[0].key == "owl" and top[0].asDict().keys() >= {"chunk_id", "title", "year", "doi", "text", "score"}
    notes = library.search_lines(shelf.get("notes"), "notes", "owl heard", str(place.folder), 3).collect()
    assert notes[0].note == "sub dir/day+1" and notes[0].current is True and (notes[0].line_start, notes[0].line_end) == (2, 4)
    lines = library.search_lines(shelf.get("thesis"), "thesis", "owls", str(place.folder), 1).collect()
    assert lines[0]["keys"] == ["owl"] and lines[0].current is True
    (place.folder / "chapters" / "one.tex").write_text("\\chapter{Birds}\nNew.\n\nOther.\n")
    assert library.search_lines(shelf.get("thesis"), "thesis", "owls", str(place.folder), 1).first().current is False
    links = dict(report.file_links({**notes[0].asDict(), "doi": "10.1/x"}, str(place.folder), "My vault"))
    assert links["DOI"] == "https://doi.org/10.1/x" and links["Obsidian"] == "obsidian://open?vault=My%20vault&file=sub%20dir%2Fday%2B1" and links["Markdown"].endswith("day%2B1.md#L2")
    (place.papers / "Fir 2003 - Ferns.md").write_text("Ferns.")
    assert any("1 new files" in line for line in build.readiness(spark, place)[0])
    build.main(["ingest", "chunk", "index", "--project", str(place.folder)], spark)
    assert shelf.get("library") is not held


def test_evaluation_run(spark):
    texts = ["owls hunt 5 voles", "moss holds water", "peat burns", "ferns"]
    chunks = spark.createDataFrame([(k, f"p{k}", t, t) for k, t in enumerate(texts)], "pos long, paper string, text string, index_text string")
    pairs = spark.createDataFrame([("c", 0, "owls and 5 voles", "p0", ["5"]), ("c", 1, "wet moss water", "p1", []), ("c", 2, "unknown words", "p2", [])], "chunk_id string, position long, query string, key string, numbers array<string>")
    questions, answers = evalrun.pair_questions(pairs)
    by_words = lexical.bm25(chunks, questions)
    other = by_words.withColumn("rank", F.lit(5).cast("long") - F.col("rank"))
    run = evalrun.evaluate(questions, answers, {"bm25": by_words, "other": other}, chunks.select("pos", "paper"), chunks, [("bm25",), ("other",), ("bm25", "other")], (1, 2))
    rows = {(r["config"], r["metric"]): r["mean"] for r in evalrun.summarised(run)}
    assert rows["bm25", "hit@1"] == pytest.approx(2 / 3, abs=1e-9) and run.best == "bm25+other" and run.numbers["bm25"] == 1.0
    markdown, told = evalrun.report(run, "bm25")
    assert "| bm25 |" in markdown and "reranked 2" in markdown and "–" in markdown and '"best": "bm25+other"' in told
    entries = spark.createDataFrame([(1, "s1", ["A", "b"]), (2, "s2", ["c"]), (3, "s3", ["d"])], "query_id long, summary string, keys array<string>")
    passages = spark.createDataFrame([("x", "paragraph", ["B", "a"]), ("y", "paragraph", ["c"]), ("z", "paragraph", ["C"]), ("w", "caption", ["d"])], "chunk_id string, kind string, keys array<string>")
    assert [tuple(r) for r in evalrun.book_questions(entries, passages)[1].collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        evalrun.realistic_questions(spark.createDataFrame([(1, "q", ["nokey"])], "query_id long, text string, keys array<string>"), spark.createDataFrame([("k",)], "key string"))
