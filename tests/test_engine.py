"""Engine operators on made-up rows."""

import random
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import chunking, evaluation, lexical, linkage, ranking, vectors
from passagemill.plans import library_queries
from passagemill.sources import readers
from passagemill.streaming import ingest


def value(spark, expression, *columns):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("See Fig. 2 of Lee et al. It holds. Next one! (Good.) then more", ["See Fig. 2 of Lee et al. It holds.", "Next one!", "(Good.) then more"]),
        ("M. Smith came, e.g. Here. 5.2. Then", ["M. Smith came, e.g. Here.", "5.2.", "Then"]),
        ("", []),
    ],
)
def test_sentences(spark, given, wanted):
    assert value(spark, T.sentences(F.lit(given))) == wanted


def test_text_functions(spark):
    assert value(spark, T.tidy(F.lit("as shown [1, 2] ( here ) , and ( 3 ) ."))).startswith("as shown [1, 2] (here)")
    assert value(spark, T.heading(F.lit("2.1 Data collection:"))) == "Data collection"
    assert value(spark, T.is_boilerplate(F.lit("5. Authors’ contributions."))) and not value(spark, T.is_boilerplate(F.lit("Ethical and regulatory considerations")))
    assert value(spark, T.numbers(F.lit("H1N1 in 1,234 of 2,000, sites 1,2, COVID-19, 10^5"))) == ["1234", "2000", "1", "2", "10^5"]
    assert value(spark, T.query_terms(F.lit("What is the A virus 7 of the virus"))) == ["virus", "7"]
    assert value(spark, T.index_text(F.lit("Who?"), F.lit(""), F.lit("It"))) == "Who? It"
    assert value(spark, T.word_count(F.lit("a b  c"))) == 3 and value(spark, T.word_count(F.lit(" "))) == 0
    assert value(spark, T.normalise_doi(F.lit("https://doi.org/10.1000/AB\\_c.)"))) == "10.1000/ab_c"
    assert value(spark, T.is_current(F.lit("x\ny\nz"), F.lit(2), F.lit(3), T.fingerprint(F.lit("y\nz"))))


def test_split_and_gather(spark):
    assert [len(p.split()) for p in chunking.split_words([" ".join(["w"] * 9 + ["w."])] * 45)] == [230, 220]
    assert [len(p.split()) for p in chunking.split_words([" ".join(["w"] * 700)])] == [234, 234, 232]
    assert value(spark, chunking.run_numbers(F.array(*(F.lit(n) for n in (120, 120, 120, 30, 301, 5))))) == [0, 0, 1, 1, 2, 3]
    docs = spark.createDataFrame([(1, [" ".join(["a"] * 120)] * 3 + ["", " ".join(["b"] * 30)])], "doc long, paragraphs array<string>")
    assert [(r["n"], r["words"]) for r in chunking.merge_paragraphs(docs).orderBy("n").collect()] == [(0, 240), (1, 150)]


def test_bm25_prefers_the_shorter_chunk(spark):
    chunks = spark.createDataFrame([(0, "virus in bats and birds"), (1, "virus"), (2, "birds"), (3, "soil"), (4, "rain")], "pos long, index_text string")
    asked = spark.createDataFrame([(1, "virus virus"), (2, "nothing")], "query_id long, text string")
    assert [(r["query_id"], r["pos"], r["rank"]) for r in lexical.bm25(chunks, asked).orderBy("rank").collect()] == [(1, 1, 1), (1, 0, 2)]


def test_dense_and_fusion(spark):
    store = spark.createDataFrame([(k, [1.0 if j == k else 0.0 for j in range(4)]) for k in range(4)], "pos long, vector array<double>")
    asked = spark.createDataFrame([(7, [0.1, 0.9, 0.0, 0.5])], "query_id long, vector array<double>")
    assert [r["pos"] for r in ranking.dense(store, asked).orderBy("rank").collect()] == [1, 3, 0, 2]
    places = [(0, m, p, n + 1) for m, items in enumerate(((1, 2, 3), (2, 3, 4))) for n, p in enumerate(items)]
    fused = ranking.rrf(spark.createDataFrame(places, "query_id long, method_no int, pos long, rank long")).orderBy("rank").collect()
    assert [r["pos"] for r in fused] == [2, 3, 1, 4] and fused[0]["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_dense_answers_every_block_of_queries(spark, monkeypatch):
    store = spark.createDataFrame([(k, [float(k == j) for j in range(4)]) for k in range(4)], "pos long, vector array<float>")
    asked = spark.createDataFrame([(k, [float(k + j == 6) + 0.1 * j for j in range(4)]) for k in range(7)], "query_id long, vector array<float>").repartition(3)
    whole = {tuple(r) for r in ranking.dense(store, asked, 3).collect()}
    assert len(whole) == 21
    for bound in (1, 3, 7):
        monkeypatch.setattr(ranking, "MAX_QUERY_VECTORS", bound)
        assert {tuple(r) for r in ranking.dense(store, asked, 3).collect()} == whole
    assert ranking.dense(store, asked.limit(0)).count() == 0


def test_rerank_keeps_ties_and_tail(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(("b", "a", "b", "a"))], "pos long, index_text string")
    fused = spark.createDataFrame([(1, k, k + 1) for k in range(4)], "query_id long, pos long, rank long")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert [r["pos"] for r in ranking.rerank(fused, asked, chunks, depth=3).orderBy("rank").collect()] == [1, 0, 2]
    assert [r["pos"] for r in ranking.rerank(fused, asked, chunks, depth=3, keep_tail=True).orderBy("rank").collect()] == [1, 0, 2, 3]
    at = spark.createDataFrame([(k, "p" if k < 3 else "q") for k in range(5)], "pos long, document string")
    assert sorted(r["pos"] for r in ranking.neighbours(at, at.filter("pos = 2").select("pos"), 1).collect()) == [1, 2]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 12)], "query_id long, place long")
    got = {(r["query_id"], r["metric"]): r["value"] for r in evaluation.metric_values(found).collect()}
    assert [got[k, "hit@1"] for k in (1, 2, 3, 4)] == [1, 0, 0, 0] and [got[k, "mrr"] for k in (1, 2, 3, 4)] == [1, pytest.approx(1 / 3), 0, 0]


def test_linkage(spark):
    entries = spark.createDataFrame([("k1", "10.1/a", "a study of bats and their many viruses", False, 0), ("k2", "10.1/a", "a study of bats and their many viruses", True, 1), ("k3", None, "soil", False, 2)], "key string, doi string, title string, cited boolean, pos int")
    records = spark.createDataFrame([(1, "10.1/a", "x"), (2, None, "soil"), (3, None, "a study of bats and their many virus"), (4, None, "none")], "record long, doi string, title string")
    got = {r["record"]: (r["key"], r["matched_by"]) for r in linkage.link_cascade(records, entries).collect()}
    assert got == {1: ("k2", "doi"), 2: ("k3", "title"), 3: ("k2", "similar title"), 4: (None, None)}
    rows = spark.createDataFrame([("b", "p", True, None), ("a", "p", True, "PMC1"), ("c", "q", False, None)], "source_file string, paper_id string, citable boolean, pmcid string")
    assert {r["source_file"]: r["duplicate_of"] for r in linkage.mark_duplicates(rows).collect()} == {"a": None, "b": "a", "c": None}


def test_similar_titles_by_brute_force(spark):
    pairs = [("krankenhausinformationssysteme", "krankenhausinformationssystemen"), ("phenylalaninehydroxylase deficiencysyndrome", "phenylalanine hydroxylase deficiency syndrome"), ("electroencephalographic neurophysiology", "electroencephalografic neurophysiologie")]
    r = random.Random(4)
    for _ in range(150):
        x = "".join(r.choice("abcdé 日") for _ in range(r.randrange(18, 60))) + r.choice(["", "a" * 40])
        y = list(x)
        for _ in range(r.randrange(4)):
            y[r.randrange(len(y))] = r.choice(["", "a", "xy"])
        pairs.append((x, "".join(y)))
    entries = [(k, k % 3 == 0, k, y) for k, (_, y) in enumerate(pairs)] + [(900, False, -1, pairs[0][1]), (901, False, 901, "")]
    wanted = {}
    for n, (x, _) in enumerate(pairs):
        found = [(-SequenceMatcher(None, x, y, autojunk=False).ratio(), not cited, pos, key) for key, cited, pos, y in entries]
        if len(x) >= linkage.MIN_TITLE and -min(found)[0] >= linkage.TITLE_SIMILARITY:
            wanted[n] = (min(found)[3], -min(found)[0])
    assert set(wanted) >= {0, 1, 2} and 50 < len(wanted) < len(pairs)
    got = linkage.similar_titles(spark.createDataFrame([(n, x) for n, (x, _) in enumerate(pairs)], "record long, title string"), spark.createDataFrame(entries, "key long, cited boolean, pos long, title string"))
    assert {row["record"]: (row["key"], row["ratio"]) for row in got.collect()} == wanted


def test_similar_title_takes_every_part(spark, tmp_path):
    rows = [(k, "grey wrench", "economy plated") for k in range(150, 260)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["record"]: r["key"] for r in library_queries.similar_title(spark, str(tmp_path)).collect()} == {k: k for k in range(150, 260)}


def _seen_by_blocks(monkeypatch):
    """The titles that are compared in blocks, call by call."""
    seen, blocks = [], linkage._blocks

    def recorded(titles, band):
        seen.append({r["title"] for r in titles.select("title").collect()})
        return blocks(titles, band)

    monkeypatch.setattr(linkage, "_blocks", recorded)
    return seen


def test_similar_titles_one_character_off_are_not_compared_with_all(spark, monkeypatch):
    names = [f"large ring standard {n}" for n in range(1000, 1060)]
    records = spark.createDataFrame([(n, x + "s") for n, x in enumerate(names)], "record long, title string")
    entries = spark.createDataFrame([(n, False, n, x) for n, x in enumerate(names)], "key long, cited boolean, pos long, title string")
    seen = _seen_by_blocks(monkeypatch)
    assert {r["record"]: r["key"] for r in linkage.similar_titles(records, entries).collect()} == {n: n for n in range(60)}
    assert not any(seen)
    far = spark.createDataFrame([(100, "large ring standard 10x9s"), (101, "another title altogether")], "record long, title string")
    assert {r["record"]: r["key"] for r in linkage.similar_titles(records.union(far), entries).collect()} == {n: n for n in range(60)} | {100: 9}
    assert seen[1] == {"large ring standard 10x9s", "another title altogether"}


@pytest.mark.parametrize("longest", [500, 26])
def test_similar_titles_near_by_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(linkage, "_LONGEST", longest)
    r = random.Random(6)
    entries, records = [], []
    for k in range(120):
        x = "".join(r.choice(("ab", "aé日", "abcdefgh ")[k % 3]) for _ in range(r.randrange(19, 31)))
        for _ in range(2):
            y = list(x)
            for _ in range(r.choice((0, 1, 1, 1, 2))):
                at = r.randrange(len(y))
                y[at] = r.choice(["", y[at] * 2, y[at] + "a"])
            entries.append((len(entries), len(entries) % 3 == 0, -len(entries), "".join(y)))
        records.append((k, x))
    wanted = {}
    for n, x in records:
        found = min((-SequenceMatcher(None, x, y, autojunk=False).ratio(), not cited, pos, key) for key, cited, pos, y in entries)
        if len(x) >= linkage.MIN_TITLE and -found[0] >= linkage.TITLE_SIMILARITY:
            wanted[n] = (found[3], -found[0])
    got = linkage.similar_titles(spark.createDataFrame(records, "record long, title string"), spark.createDataFrame(entries, "key long, cited boolean, pos long, title string"))
    assert len(wanted) > 80 and {row["record"]: (row["key"], row["ratio"]) for row in got.collect()} == wanted


def test_link_cascade_compares_open_titles_only_and_keeps_each_record_once(spark, monkeypatch):
    names = [f"large ring standard {n}" for n in range(1000, 1040)]
    entries = spark.createDataFrame([(n, f"10.1/{n}" if n % 8 == 0 else None, x, False, n) for n, x in enumerate(names)], "key long, doi string, title string, cited boolean, pos long")
    rows = [(n, f"10.1/{n}" if n % 8 == 0 else None, "another title altogether" if n % 8 == 0 else x + "s" * (n % 2)) for n, x in enumerate(names)]
    rows += [(1, None, names[1] + "s"), (1, None, None), (None, "", names[3] + "s"), (90, None, "another title altogether")]
    seen = _seen_by_blocks(monkeypatch)
    got = linkage.link_cascade(spark.createDataFrame(rows, "record long, doi string, title string"), entries).collect()
    wanted = [(n, n, "doi" if n % 8 == 0 else "title" if n % 2 == 0 else "similar title") for n in range(40)]
    wanted += [(1, 1, "similar title"), (1, None, None), (None, 3, "similar title"), (90, None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert seen[0] == {"another title altogether"}


def test_rows_without_a_value_do_not_meet_in_one_partition(spark):
    rows = spark.range(4000).select(F.col("id").alias("record"), F.lit(None).cast("string").alias("doi"))
    keys = spark.createDataFrame([("10.1/a", 1)], "doi string, key long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = linkage._with_key(rows, "doi", keys, "_key").withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.count("*").alias("n"), F.count("_key").alias("hits")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n"] for r in found) == 4000 and max(r["n"] for r in found) < 2000 and not any(r["hits"] for r in found)


def test_stored_tables_are_released(spark):
    kept = linkage._stored(spark.range(5).select(F.struct("id").alias("record")))
    path = Path(linkage._written[-1].removeprefix("file:"))
    assert kept.count() == 5 and path.is_dir()
    linkage.release_stored(spark)
    assert not path.exists() and not linkage._written


def test_vector_table(spark):
    chunks = spark.createDataFrame([(0, "h1", "A.", "x"), (1, "h2", "B.", "y"), (2, "h2", "B.", "y")], "pos long, text_hash string, header string, text string")
    store = spark.createDataFrame([("h1", [1.0]), ("h9", [2.0])], "text_hash string, vector array<float>")
    with pytest.raises(vectors.StaleIndex):
        vectors.load_vectors(chunks, store)
    fresh = vectors.refreshed_store(chunks, store)
    assert sorted(r["text_hash"] for r in fresh.collect()) == ["h1", "h2"] and vectors.load_vectors(chunks, fresh).count() == 3


def test_readers(spark, tmp_path):
    source = "---\nx: 1\n---\n# Day %%no%%1 #\ntext [[Note|alias]] ==hot==\n%% gone\nstill gone %%\n```\n# code %% x\n```\n\n## Panel\nmore ^ab1\n![[p.png]]\n"
    notes = spark.createDataFrame([("n", source)], "note string, source string")
    got = [(r["section"], r["line_start"], r["line_end"], r["text"]) for r in readers.note_blocks(notes).orderBy("n").collect()]
    assert got == [("Day 1", 5, 5, "text alias hot"), ("Day 1", 8, 10, "```\n# code %% x\n```"), ("Day 1 > Panel", 13, 13, "more")]
    bib = spark.createDataFrame([('@comment{x}\n@article{k1, title = {A {B} c}, year = 2001, title={z}}\n@book{K2, doi = "10.1/x"}',)], "text string")
    assert [(r["kind"], r["key"], r["fields"]) for r in readers.bib_fields(bib).orderBy("pos").collect()] == [("article", "k1", {"title": "A {B} c", "year": "2001"}), ("book", "K2", {"doi": "10.1/x"})]
    more = spark.createDataFrame([('@article{Key,\n title = {{\\\'E}lan   {vital}},\n url = "http://doi.org/10.1000/Ab.", note = "a \\" b", date = {2019-07-01}}\n@book{other, title = "Elan vital", year = {in 1999}}',)], "text string")
    found = readers.bib_entries(more, spark.createDataFrame([("\\bibitem[x]{KEY}\nText",)], "text string")).orderBy("pos").collect()
    assert [(r["key"], r["doi"], r["title"], r["year"], r["cited"]) for r in found] == [("Key", "10.1000/ab", "elan vital", 2019, True), ("other", None, "elan vital", 1999, False)]
    assert readers.bib_fields(more).orderBy("pos").first()["fields"]["note"] == 'a \\" b'
    md = spark.createDataFrame([("# The Title.\n- Year: 2001\n- PMID: N/A\n## Extracted Full Text\n## Page 1\none  two\n## Page 2\n\n",)], "t string")
    row = md.select(readers.metadata(F.col("t")).alias("m"), readers.pages(F.col("t")).alias("p"), readers.page_count(F.col("t")).alias("n")).first()
    assert row["m"] == {"Year": "2001", "Title": "The Title"} and row["p"] == ["one two"] and row["n"] == 2
    (tmp_path / "a.md").write_text("x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.md").write_text("y")
    assert [p.rsplit("/", 1)[1] for p in readers.note_files(str(tmp_path))] == ["a.md"]
    assert readers.read_texts(spark, str(tmp_path)).first()["text"] == "x"


def test_notes_chunk_with_lines(spark):
    source = "---\nx: 1\n---\n# A\none\n\n" + " ".join(["w"] * 250) + "\n\n" + " ".join(["v"] * 60) + "\n## B\nNotes for x.pdf:\n> show annotation\n%%\n# no\n%%\nlast\n## B\n~~~\n\n# code\n~~~~"
    notes = spark.createDataFrame([("n", "n.md", source), ("empty", "e.md", None)], "note string, file string, source string")
    got = chunking.chunk_notes(notes).orderBy("n").collect()
    assert [(r["chunk_id"], r["section"], r["line_start"], r["line_end"], len(r["text"].split())) for r in got] == [("n#0", "A", 5, 7, 251), ("n#1", "A", 9, 9, 60), ("n#2", "A > B", 16, 16, 1), ("n#3", "A > B", 18, 21, 4)]
    lines = source.split("\n")
    for r in got:
        assert r["hash"] == value(spark, T.fingerprint(F.lit("\n".join(lines[r["line_start"] - 1 : r["line_end"]]))))
    assert got[3]["text"] == "~~~\n# code\n~~~~"


def test_papers_chunk_with_cites(spark):
    p = lambda text, *cites: (text, list(cites))
    long = " ".join(["aa"] * 99 + ["aa."]) + " " + " ".join(["B"] * 350)
    row = ("p", "k", True, "T", 2000, None, "f.md", "Short abstract.", [("One", [p("x", "r1"), p("y", "r2", "r1"), p(" ")]), ("One", [p(long, "r9")])], [("Fig 1", "cap", ["r2"])], {"r1": ("R1",), "r2": ("R2",)})
    kinds = "sections array<struct<heading:string,paragraphs:array<struct<text:string,cites:array<string>>>>>, captions array<struct<label:string,text:string,cites:array<string>>>, references map<string,struct<text:string>>"
    papers = spark.createDataFrame([row], f"paper_id string, key string, citable boolean, title string, year int, doi string, source_file string, abstract string, {kinds}")
    got = chunking.chunk_papers(papers).orderBy("n").collect()
    assert [(r["chunk_id"], r["section"], r["kind"], [c["text"] for c in r["cites"]]) for r in got] == [("p#0", "Abstract", "abstract", []), ("p#1", "One", "body", ["R1", "R2"]), ("p#2", "One", "body", []), ("p#3", "One", "body", []), ("p#4", "Fig 1", "caption", ["R2"])]
    assert got[1]["text"] == "x\n\ny" and [len(r["text"].split()) for r in got[2:4]] == [275, 175]


def test_titles_fold_and_ranges_are_safe(spark):
    assert value(spark, T.normalise_title(F.lit("Élan vital: the ﬁrst – part ½"))) == "elan vital the first part 12"
    assert value(spark, T.is_current(F.lit("x"), F.lit(0), F.lit(1), F.lit("h"))) is False
    assert value(spark, T.note_line(F.lit("> [!note] ![[a.png]] [[N#h|al]] [[M]] [t](u) ==hi== ^id"))) == "> al M t hi"
    assert value(spark, T.note_line(F.lit("Notes for a b.pdf:"))) == ""


def test_stream_adds_each_text_once(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    for k in range(2):
        spark.createDataFrame([(k, "same", "s"), (k + 10, f"own {k}", "s")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        ingest.ingest_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    assert ingest.read_store(spark, f"{tmp_path}/store").count() == 3
