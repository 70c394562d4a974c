"""Cutting and merging paragraphs into passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.sources import readers

CHUNK_WORDS, SPLIT_WORDS = 300, 400


def split_words(sentences: list[str], limit: int = CHUNK_WORDS) -> list[str]:
    """Pieces of a long passage: whole sentences up to ``limit`` words, closed early once an even share is reached.

    A sentence over the limit is first cut between words into even parts.
    """
    units: list[list[str]] = []
    for words in (s.split(" ") for s in sentences):
        parts = -(-len(words) // limit)
        step = -(-len(words) // parts)
        units += [words[k : k + step] for k in range(0, len(words), step)]
    total = sum(map(len, units))
    share = total / max(1, -(-total // limit))
    pieces, current = [], []
    for unit in units:
        if current and len(current) + len(unit) > limit:
            pieces.append(current)
            current = []
        current = current + unit
        if len(current) >= share:
            pieces.append(current)
            current = []
    return [" ".join(p) for p in (*pieces, current) if p]


def _split(sentences: pd.Series) -> pd.Series:
    # A fold with early closing; as a nested SQL lambda it copies its state at every step.
    return pd.Series([split_words(list(s)) if s is not None else [] for s in sentences], dtype=object)


def split_passage(text: Column) -> Column:
    return F.pandas_udf(_split, "array<string>")(T.sentences(text))


def pieces(text: Column) -> Column:
    """A passage as it enters a chunk: nothing if blank, whole up to SPLIT_WORDS, else cut."""
    return F.when(T.collapse(text) == "", F.array().cast("array<string>")).when(T.word_count(text) > SPLIT_WORDS, split_passage(text)).otherwise(F.array(text))


def run_numbers(sizes: Column, limit: int = CHUNK_WORDS) -> Column:
    """The run of each size in order: a size joins the run before it while the sum stays within ``limit``."""
    start = F.from_json(F.lit('{"runs":[],"count":0,"run":-1}'), "struct<runs:array<int>,count:int,run:int>")

    def step(state: Column, size: Column) -> Column:
        new = (state["run"] < 0) | (state["count"] + size > limit)
        run = F.when(new, state["run"] + 1).otherwise(state["run"])
        return F.struct(F.array_append(state["runs"], run).alias("runs"), F.when(new, size).otherwise(state["count"] + size).cast("int").alias("count"), run.cast("int").alias("run"))

    return F.aggregate(sizes, start, step, lambda s: s["runs"])


def merge_parts(parts: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """(keys, run, group): parts of each key gathered in order. ``parts`` has keys, p (order), text and the columns ``extra``.

    ``group`` lists structs (p, q, text, extra): a part over SPLIT_WORDS is cut
    and q numbers its pieces, each with all of ``extra``; blank parts go.
    Cutting happens on rows of one part, and only long ones leave the JVM; the
    parts of a key come back together by p and q.
    """
    size = T.word_count(F.col("text"))
    short = parts.filter(size <= SPLIT_WORDS).select(*keys, "p", *extra, F.filter(F.array("text"), lambda x: T.collapse(x) != "").alias("cut"))
    long = parts.filter(size > SPLIT_WORDS).select(*keys, "p", *extra, split_passage(F.col("text")).alias("cut"))
    pieces_of = short.unionByName(long).select(*keys, "p", *extra, F.posexplode("cut").alias("q", "text"))
    together = pieces_of.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "q", "text", *extra))).alias("parts"))
    runs = together.withColumn("runs", run_numbers(F.transform("parts", lambda x: T.word_count(x["text"]))))
    grouped = F.transform(
        F.sequence(F.lit(0), F.array_max("runs")), lambda r: F.transform(F.filter(F.arrays_zip("parts", "runs"), lambda x: x["runs"] == r), lambda x: x["parts"])
    )
    return runs.select(*keys, F.posexplode(grouped).alias("run", "group"))


def joined(group: Column) -> Column:
    return F.array_join(F.transform(group, lambda x: x["text"]), "\n\n")


def merged_cites(group: Column) -> Column:
    """The cites of all parts of a passage, each once, in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(group, lambda x: x["cites"])))


def merge_paragraphs(documents: DataFrame) -> DataFrame:
    """(doc, n, text, words) passages from (doc, paragraphs): cut, gathered within the document, joined by a blank line."""
    parts = documents.select("doc", F.posexplode("paragraphs").alias("p", "text"))
    found = merge_parts(parts, ["doc"], []).select("doc", F.col("run").cast("long").alias("n"), joined(F.col("group")).alias("text"))
    return found.withColumn("words", T.word_count(F.col("text")).cast("long"))


def chunk_papers(papers: DataFrame) -> DataFrame:
    """Passages of papers in reading order: the abstract, the body section by section, the captions.

    papers has paper_id, key, citable, title, year, doi, source_file, abstract,
    sections, captions and references as articles are read. Body paragraphs are
    gathered within their section; abstracts and captions are only cut. ``cites``
    are the references themselves, those of all paragraphs of a passage, each
    once; ids without a reference are left out. chunk_id is paper_id#n.
    """
    own = ["paper_id", "key", "citable", "title", "year", "doi", "source_file"]
    none = F.array().cast("array<string>")
    body = papers.select("paper_id", F.posexplode("sections").alias("block", "s")).select("paper_id", "block", F.col("s.heading").alias("section"), F.posexplode("s.paragraphs").alias("p", "x"))
    merged = merge_parts(body.select("paper_id", "block", "section", "p", "x.text", "x.cites"), ["paper_id", "block", "section"], ["cites"])
    passages = merged.select("paper_id", F.lit(1).alias("part"), "block", F.col("run").alias("m"), "section", F.lit("body").alias("kind"), joined(F.col("group")).alias("text"), merged_cites(F.col("group")).alias("ids"))

    def alone(rows: DataFrame, part: int, kind: str) -> DataFrame:
        cut = rows.select("paper_id", "block", "section", "ids", F.posexplode(pieces(F.col("text"))).alias("m", "text"))
        return cut.select("paper_id", F.lit(part).alias("part"), "block", "m", "section", F.lit(kind).alias("kind"), "text", "ids")

    abstracts = papers.select("paper_id", F.lit(0).alias("block"), F.lit("Abstract").alias("section"), F.coalesce("abstract", F.lit("")).alias("text"), none.alias("ids"))
    captions = papers.select("paper_id", F.posexplode("captions").alias("block", "c")).select("paper_id", "block", F.col("c.label").alias("section"), "c.text", F.col("c.cites").alias("ids"))
    every = passages.unionByName(alone(abstracts, 0, "abstract")).unionByName(alone(captions, 2, "caption"))
    order = Window.partitionBy("paper_id").orderBy("part", "block", "m")
    numbered = every.withColumn("n", F.row_number().over(order) - 1).join(papers.select(*own, "references"), "paper_id")
    cites = F.filter(F.transform("ids", lambda rid: F.try_element_at("references", rid)), lambda r: r.isNotNull())
    return numbered.select(F.concat("paper_id", F.lit("#"), "n").alias("chunk_id"), *own, "n", "section", "kind", "text", cites.alias("cites"))


def chunk_notes(notes: DataFrame) -> DataFrame:
    """(chunk_id, note, file, n, line_start, line_end, section, text, hash) passages of notes (note, file, source), gathered within their section.

    The lines are those of the first and the last paragraph of a passage;
    ``hash`` is the fingerprint of these lines as they stand in the file.
    """
    blocks = readers.note_blocks(notes).select("note", "section_no", "section", F.col("n").alias("p"), "text", "line_start", "line_end")
    merged = merge_parts(blocks, ["note", "section_no", "section"], ["line_start", "line_end"])
    order = Window.partitionBy("note").orderBy("section_no", "run")
    placed = merged.select(
        "note", "section", F.row_number().over(order).alias("n"), joined(F.col("group")).alias("text"),
        F.element_at("group", 1)["line_start"].alias("line_start"), F.element_at("group", -1)["line_end"].alias("line_end"),
    ).withColumn("n", F.col("n") - 1)
    lines = F.slice(F.split("source", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    return placed.join(notes.select("note", "file", "source"), "note").select(
        F.concat("note", F.lit("#"), "n").alias("chunk_id"), "note", "file", "n", "line_start", "line_end", "section", "text", T.fingerprint(F.array_join(lines, "\n")).alias("hash")
    )
