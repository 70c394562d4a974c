"""The query interface over a collection of passages."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import lexical, ranking

MAX_HITS, MAX_WINDOW = 20, 5


class UnknownChunk(KeyError):
    """No collection has a chunk of this id."""


@dataclass
class Collection:
    """Passages in reading order and their vectors.

    chunks has pos, chunk_id, document, index_text and the columns to show;
    vectors maps a method's name to (pos, vector) rows and to the function
    that turns a question into a vector.
    """

    name: str
    chunks: DataFrame
    vectors: dict[str, tuple[DataFrame, Callable[[str], list[float]]]] = field(default_factory=dict)
    scorer: Callable = ranking.lexical_scorer
    index: lexical.Index | None = None

    @property
    def methods(self) -> tuple[str, ...]:
        return ("bm25", *self.vectors)


def search_batch(collection: Collection, questions: DataFrame, methods: Sequence[str] | None = None, rerank: bool = True) -> DataFrame:
    """(query_id, pos, score, rank, ranks) for all questions (query_id, text) in one plan; ``ranks`` maps each method to its place.

    With ``rerank`` only the shortlist that was scored again is returned.
    """
    methods = tuple(collection.methods if methods is None else methods)
    unknown = [m for m in methods if m not in collection.methods]
    if unknown or not methods:
        raise ValueError(f"unknown methods {unknown}; choose from {', '.join(collection.methods)}")
    found = {}
    for method in methods:
        if method == "bm25":
            by_words = lexical.bm25_stored(collection.index, questions) if collection.index else lexical.bm25(collection.chunks, questions)
            found[method] = by_words.select("query_id", "pos", "score", "rank")
        else:
            vectors, encode = collection.vectors[method]
            asked = [(q.query_id, [float(x) for x in encode(q.text)]) for q in questions.select("query_id", "text").toLocalIterator()]
            queries = questions.sparkSession.createDataFrame(asked, "query_id long, vector array<double>")
            found[method] = ranking.dense(vectors, queries).select("query_id", "pos", "score", "rank")
    final = ranking.fuse(list(found.values()))
    if len(found) > 1:
        found["fused"] = final
    places = None
    for name, place in found.items():
        part = place.select("query_id", "pos", F.struct(F.lit(name).alias("method"), F.col("rank").cast("int").alias("place")).alias("entry"))
        places = part if places is None else places.unionByName(part)
    ranks = places.groupBy("query_id", "pos").agg(F.map_from_entries(F.collect_list("entry")).alias("ranks"))
    if rerank:
        final = ranking.rerank(final, questions, collection.chunks, scorer=collection.scorer)
    return final.select("query_id", "pos", "score", "rank").join(ranks, ["query_id", "pos"])


def search(collection: Collection, question: str, k: int = 8, methods: Sequence[str] | None = None, rerank: bool = True, citable_only: bool = False) -> DataFrame:
    """The best ``k`` passages for one question, best first; citability is tested after ranking, within the shortlist."""
    if not 1 <= k <= MAX_HITS:
        raise ValueError(f"k must be from 1 to {MAX_HITS}")
    asked = collection.chunks.sparkSession.createDataFrame([(0, question)], "query_id long, text string")
    hits = search_batch(collection, asked, methods, rerank).join(collection.chunks, "pos")
    if citable_only:
        hits = hits.filter("citable")
    return hits.orderBy("rank").limit(k).drop("query_id", "index_text").withColumn("score", F.round("score", 3))


def get_context(collections: Sequence[Collection], chunk_id: str, window: int = 1) -> DataFrame:
    """A passage and up to ``window`` on either side in its document, from the first collection that has it."""
    if not 0 <= window <= MAX_WINDOW:
        raise ValueError(f"window must be from 0 to {MAX_WINDOW}")
    for collection in collections:
        wanted = collection.chunks.filter(F.col("chunk_id") == chunk_id).select("pos").limit(1)
        if not wanted.isEmpty():
            near = ranking.neighbours(collection.chunks, wanted, window).select("pos")
            return collection.chunks.join(near, "pos", "left_semi").orderBy("pos").drop("index_text")
    raise UnknownChunk(f"No chunk {chunk_id!r}; a chunk's id changes when its lines move")


def with_current(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Add whether a passage's lines still hold it; ``sources`` has (file, source), a file that is gone has no text."""
    joined = hits.join(sources.select("file", F.col("source").alias("_source")), "file", "left")
    text = F.coalesce("_source", F.lit(""))
    return joined.withColumn("current", T.is_current(text, F.col("line_start"), F.col("line_end"), F.col("hash"))).drop("_source", "hash")


#: What a passage of each collection shows, in this order.
SHOWN = {
    "library": ("chunk_id", "key", "title", "year", "doi", "source_file", "section", "text", "cites", "citable"),
    "thesis": ("chunk_id", "file", "line_start", "line_end", "section", "kind", "text", "keys"),
    "notes": ("chunk_id", "note", "file", "line_start", "line_end", "section", "text"),
}


def shaped(hits: DataFrame, kind: str, sources: DataFrame | None = None) -> DataFrame:
    """Hits with the columns that a collection of ``kind`` shows, whether their lines still hold (given ``sources``), and their score if they have one."""
    rows = with_current(hits, sources) if sources is not None else hits
    more = [c for c in ("current", "score", "rank") if c in rows.columns]
    return rows.select(*(c for c in SHOWN[kind] if c in rows.columns), *more)


def sources_of(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    """(file, source): the present text of the files behind hits; one that is gone has none. Hits are few, so their files are named."""
    names = [r["file"] for r in hits.select("file").distinct().limit(MAX_HITS + 1).collect()]
    there = [n for n in names if _exists(spark, f"{folder}/{n}")]
    if not there:
        return spark.createDataFrame([], "file string, source string")
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in there])
    ends = F.substring_index("path", "/", -1) if all("/" not in n for n in there) else F.element_at(F.filter(F.array(*map(F.lit, there)), lambda n: F.endswith(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.concat(F.lit("/"), n))), 1)
    return files.select(ends.alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def search_library(collection: Collection, question: str, k: int = 8, citable_only: bool = True) -> DataFrame:
    """Passages of papers; those that may not be cited are left out after ranking."""
    return shaped(search(collection, question, k, citable_only=citable_only), "library")


def search_lines(collection: Collection, kind: str, text: str, folder: str, k: int = 8) -> DataFrame:
    """Passages of a book ("thesis") or of notes ("notes"), with whether their lines still hold them."""
    hits = search(collection, text, k)
    return shaped(hits, kind, sources_of(collection.chunks.sparkSession, folder, hits))


class Shelf:
    """Collections that are loaded once, and again when their stored tables have been replaced.

    ``load`` makes a collection, ``version`` tells which version is stored.
    One thread at a time loads; all see whole collections.
    """

    def __init__(self, load: Callable[[str], Collection], version: Callable[[str], str | None]):
        self._load, self._version, self._held, self._lock = load, version, {}, threading.Lock()

    def get(self, name: str) -> Collection:
        with self._lock:
            now = self._version(name)
            if name not in self._held or self._held[name][0] != now:
                self._held[name] = (now, self._load(name))
            return self._held[name][1]


@dataclass
class Answer:
    question: str
    seconds: float
    terms: list[str]
    hits: list


def answer(collection: Collection, question: str, k: int = 10, **options) -> Answer:
    """A question's hits as rows, with the words to mark."""
    start = time.time()
    hits = search(collection, question, k, **options).collect()
    terms = collection.chunks.sparkSession.range(1).select(T.query_terms(F.lit(question)).alias("t")).first()["t"]
    return Answer(question, time.time() - start, list(terms), hits)
