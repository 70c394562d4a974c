"""BM25 ranking as one relational plan over a batch of queries.

Document frequencies are counted over all terms (the floor for negative idf
needs their average), but term frequencies only for terms that a query asks
for, so what is shuffled is one row per (document, asked term).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.sources.stores import StampedTable

K1, B, EPSILON = 1.5, 0.75, 0.25
CANDIDATES = 100


def tokenized(chunks: DataFrame) -> DataFrame:
    """(pos, tokens) from (pos, index_text)."""
    return chunks.select("pos", T.tokenize(F.coalesce("index_text", F.lit(""))).alias("tokens"))


def _weighted(df: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf) from (term, df) and the number of chunks n: idf = ln((n - df + 0.5) / (df + 0.5)), negative ones replaced by EPSILON times the average idf."""
    raw = df.crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    average = raw.agg(F.avg("raw").alias("average"))
    return raw.crossJoin(F.broadcast(average)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("average")).otherwise(F.col("raw")).alias("idf"))


def term_statistics(tokens: DataFrame) -> DataFrame:
    """(term, df, idf) of all terms of (pos, tokens)."""
    df = exploded(tokens, distinct=True).groupBy("term").agg(F.count("*").alias("df"))
    return _weighted(df, tokens.agg(F.count("*").alias("n")))


def exploded(tokens: DataFrame, *more, distinct: bool = False) -> DataFrame:
    """A row (term, more) for each token. The outer form keeps the optimizer from asking for the array's size, that is, from tokenising every text twice."""
    terms = F.array_distinct("tokens") if distinct else F.col("tokens")
    return tokens.select(*more, F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull())


def top_n(scored: DataFrame, n: int, query: str = "query_id") -> DataFrame:
    """Best ``n`` rows per query by score, ties by pos; planned as a group limit before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def bm25(chunks: DataFrame, queries: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """(query_id, pos, score, rank) from chunks (pos, index_text) and queries (query_id, text).

    Each query token counts once; scores are rounded to six digits so that
    ties do not depend on the order of summation; scores <= 0 are left out.
    """
    tokens = tokenized(chunks)
    lengths = tokens.agg(F.avg(F.size("tokens")).alias("avgdl"))
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).join(term_statistics(tokens), "term")
    # Words that no query asks for are dropped before anything is grouped; the token array does not travel with them.
    words = exploded(tokens, "pos", F.size("tokens").alias("dl"))
    counted = words.join(asked.select("term").distinct(), "term").groupBy("pos", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = counted.crossJoin(F.broadcast(lengths)).join(asked, "term").groupBy("query_id", "pos").agg(F.round(F.sum(weight), 6).alias("score"))
    return top_n(scored.filter("score > 0"), n)


@dataclass
class Index:
    """A stored index: postings (term, pos, tf, dl), terms (term, df, idf) and one row (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def build_index(chunks: DataFrame) -> Index:
    """The index of (pos, index_text), from one tokenisation; write it with ``write_index`` before searching."""
    tokens = tokenized(chunks)
    postings = exploded(tokens, "pos", F.size("tokens").alias("dl")).groupBy("pos", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    totals = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    return Index(postings.select("term", "pos", "tf", "dl"), _weighted(postings.groupBy("term").agg(F.count("*").alias("df")), totals), totals)


_SCHEMAS = {"postings": "term string, pos long, tf long, dl int", "terms": "term string, df long, idf double", "totals": "n long, avgdl double"}


def index_tables(spark: SparkSession, folder: str, stamp: str = "") -> dict[str, StampedTable]:
    return {name: StampedTable(spark, f"{folder}/{name}", schema, stamp) for name, schema in _SCHEMAS.items()}


def write_index(index: Index, folder: str, stamp: str = "") -> Index:
    """Store the index, postings and terms sorted by term, so that a search reads only row groups that hold asked terms."""
    spark = index.postings.sparkSession
    tables = index_tables(spark, folder, stamp)
    tables["postings"].replace(index.postings.repartitionByRange("term").sortWithinPartitions("term", "pos"))
    tables["totals"].replace(index.totals)
    # From the written postings, which are not counted again from the texts.
    terms = _weighted(tables["postings"].read().groupBy("term").agg(F.count("*").alias("df")), tables["totals"].read())
    tables["terms"].replace(terms.repartitionByRange("term").sortWithinPartitions("term"))
    return read_index(spark, folder, stamp)


def read_index(spark: SparkSession, folder: str, stamp: str = "") -> Index:
    tables = index_tables(spark, folder, stamp)
    return Index(*(tables[name].read() for name in ("postings", "terms", "totals")))


#: Asked terms up to which the scan of a stored index gets them as a filter.
PUSHED_TERMS = 1_000


def bm25_stored(index: Index, queries: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """``bm25`` on a stored index: nothing is tokenised but the questions."""
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    names = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings, terms = index.postings, index.terms
    if len(names) <= PUSHED_TERMS:
        postings, terms = postings.filter(F.col("term").isin(names)), terms.filter(F.col("term").isin(names))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    known = asked.join(terms, "term")
    scored = postings.join(known, "term").crossJoin(F.broadcast(index.totals)).groupBy("query_id", "pos").agg(F.round(F.sum(weight), 6).alias("score"))
    return top_n(scored.filter("score > 0"), n)
