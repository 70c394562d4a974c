"""Registered queries of the retrieval engine, each over whole tables, with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import chunking, evaluation, lexical, linkage, ranking, vectors
from passagemill.partitions import spread
from passagemill.sources import latex

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: pos, text, section, index_text, document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"), "text", F.col("source").alias("section"), F.col("source").alias("document"), T.index_text(F.lit(""), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("index_text")
    )


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a query; the number is that of the benchmark item it stands for."""
    return vector_table(spark, sf_dir).filter("pos % 50 = 0").select((F.col("pos") / 50).cast("long").alias("query_id"), "vector")


# ---- shared SQL -------------------------------------------------------------------------------------------------

_IDX = "concat_ws(' ', nullif(source || '.', '.'), nullif(text, ''))"
_TOK = f"SELECT doc_id AS pos, regexp_extract_all(lower({_IDX}), '[a-z0-9]+') AS tokens FROM documents"
_TERMS = f"""tok AS MATERIALIZED ({_TOK}),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT pos, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT pos, tokens, unnest(tokens) AS term FROM tok) GROUP BY pos, tokens, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_TERMS},
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
sc AS (SELECT query_id, pos, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY query_id, pos),
bm AS MATERIALIZED (SELECT query_id, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM sc WHERE score > 0) WHERE rank <= 100)"""
_DENSE = """dn AS MATERIALIZED (SELECT query_id, pos, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM (
    SELECT q.vec_id // 50 AS query_id, v.vec_id AS pos, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 100)"""
_RRF = """rrf AS MATERIALIZED (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM (
  SELECT query_id, pos, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(m * 1000000 + rank) AS seen
  FROM (SELECT query_id, pos, rank, 0 AS m FROM bm UNION ALL SELECT query_id, pos, rank, 1 AS m FROM dn) GROUP BY query_id, pos))"""
_RR = f"""rr AS MATERIALIZED (SELECT query_id, pos, score, before, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM (
  SELECT query_id, pos, f.rank AS before, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), regexp_extract_all(lower({_IDX.replace("text", "d.text").replace("source", "d.source")}), '[a-z0-9]+')))
    / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1)::DOUBLE, 9) AS score
  FROM rrf f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.pos WHERE f.rank <= 50))"""
_ANSWERS = "ans AS MATERIALIZED (SELECT item_id AS query_id, doc_id AS pos FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_PLACES = f"""{_BM25}, {_ANSWERS},
pl AS (SELECT b.item_id AS query_id, min(bm.rank) AS place FROM benchmark b LEFT JOIN (SELECT bm.* FROM bm JOIN ans USING (query_id, pos)) bm ON bm.query_id = b.item_id GROUP BY 1)"""
_TIDY = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[\\[(][\\s,;–\\-−—]*[\\])]', '', 'g'), '\\s+([,.;:)\\]])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g'), '\\s+', ' ', 'g'))"""


# ---- scans and text functions -----------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))


def _folded(text: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_folded('text')}) AS title_md5 FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise_title(F.col("text"))).alias("title_md5"))


@query(f"SELECT doc_id, md5({_TIDY}) AS tidy_md5 FROM documents")
def tidy_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy(F.col("text"))).alias("tidy_md5"))


_HEADING_SQL = "trim(regexp_replace(coalesce(nullif(regexp_extract(trim(regexp_replace(title, '\\s+', ' ', 'g')), '^(?:\\d+(?:\\.\\d+)*\\.?|[A-Za-z]\\.|[IVX]+\\.)\\s+([A-Za-z].*)$', 1), ''), trim(regexp_replace(title, '\\s+', ' ', 'g'))), '[.:]+$', ''))"


_ABBREVIATIONS = "(" + ", ".join(f"'{a}'" for a in T.ABBREVIATIONS) + ")"


@query(f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
p AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS after,
  lower(regexp_replace(regexp_replace(regexp_replace(word, '["''”’)\\]]*$', ''), '^[(\\["''“‘]+', ''), '[.!?]+$', '')) AS core FROM u),
b AS (SELECT *, CASE WHEN after IS NOT NULL AND regexp_matches(word, '[.!?]["''”’)\\]]*$') AND NOT regexp_matches(after, '^[a-z]')
  AND core NOT IN {_ABBREVIATIONS} AND NOT regexp_full_match(core, '(?:[a-z]\\.)+[a-z]') AND NOT regexp_full_match(core, '\\pL') THEN 1 ELSE 0 END AS ends FROM p),
s AS (SELECT doc_id, i, word, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b)
SELECT doc_id, k::BIGINT AS n, md5(string_agg(word, ' ' ORDER BY i)) AS sentence_md5 FROM s GROUP BY doc_id, k HAVING string_agg(word, ' ' ORDER BY i) <> ''""")
def sentence_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.md5("s").alias("sentence_md5"))


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query(f"WITH {_TERMS} SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM post GROUP BY term")
def tokenize_tf_df(spark, sf_dir):
    tokens = lexical.tokenized(chunk_table(spark, sf_dir))
    counts = lexical.exploded(tokens, "pos").groupBy("term", "pos").agg(F.count("*").alias("tf"))
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("SELECT item_id AS query_id, array_to_string(list_filter(list_distinct_ordered, lambda t: (length(t) > 1 OR regexp_full_match(t, '[0-9]')) AND t NOT IN (" + ", ".join(f"'{s}'" for s in T.STOPWORDS) + ")), ' ') AS terms FROM (SELECT item_id, list_filter(toks, lambda t, i: list_position(toks, t) = i) AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM benchmark))")
def query_terms(spark, sf_dir):
    return query_table(spark, sf_dir).select("query_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def block_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("hash"))


@query("SELECT doc_id, substr(sha256(source || '.' || chr(10) || text), 1, 16) AS text_hash FROM documents")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(T.index_header(F.lit(""), F.col("source")), F.col("text")).alias("text_hash"))


@query(f"SELECT doc_id AS pos, md5({_IDX}) AS index_md5 FROM documents")
def index_text(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("pos", F.md5("index_text").alias("index_md5"))


@query("WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents) SELECT doc_id, array_to_string(w[1:30], ' ') || CASE WHEN len(w) > 30 THEN ' ...' ELSE '' END AS opening FROM w")
def describe_hit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.opening(F.col("text")).alias("opening"))


@query("SELECT doc_id, source || ' (' || coalesce(nullif(lang, 'en'), 'n.d.') || ')' || CASE WHEN coalesce(l.quality, 0) = 1 THEN '' ELSE ', not citable' END AS label FROM documents LEFT JOIN labels l USING (doc_id)")
def source_label(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", T.source_label(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.col("quality") == 1).alias("label"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, ''), doc_id::VARCHAR) AS paper FROM documents")
def paper_of(spark, sf_dir):
    key = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.paper_of(key, F.col("doc_id")).alias("paper"))


@query("WITH d AS (SELECT doc_id, substr(sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))), 1, 16) AS h, CASE WHEN doc_id % 3 = 0 THEN 'new line' || chr(10) || text ELSE text END AS now FROM documents) SELECT doc_id, substr(sha256(array_to_string(string_split(now, chr(10))[1:2], chr(10))), 1, 16) = h AS current FROM d")
def is_current(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = T.fingerprint(F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n"))
    now = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new line\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", T.is_current(now, F.lit(1), F.lit(2), stored).alias("current"))


# ---- chunking ---------------------------------------------------------------------------------------------------


def _paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split(F.coalesce("text", F.lit("")), "\n").alias("paragraphs"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, CASE WHEN trim(regexp_replace(line, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')) END AS n FROM p),
g AS (SELECT doc_id, i, n AS total, 0 AS run FROM w WHERE i = 1
 UNION ALL SELECT w.doc_id, w.i, CASE WHEN g.total + w.n > 300 THEN w.n ELSE g.total + w.n END, CASE WHEN g.total + w.n > 300 THEN g.run + 1 ELSE g.run END FROM g JOIN w ON w.doc_id = g.doc_id AND w.i = g.i + 1)
SELECT doc_id, run::BIGINT AS run, count(*) AS parts, max(total)::BIGINT AS words FROM g GROUP BY doc_id, run""")
def greedy_gather(spark, sf_dir):
    sized = _paragraphs(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.transform("paragraphs", T.word_count).alias("sizes"))
    rows = sized.select("doc_id", F.explode(F.arrays_zip("sizes", chunking.run_numbers(F.col("sizes")).alias("runs"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.runs").cast("long").alias("run")).agg(F.count("*").alias("parts"), F.sum("x.sizes").cast("long").alias("words"))


# ---- retrieval --------------------------------------------------------------------------------------------------


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(spark, sf_dir):
    return lexical.term_statistics(lexical.tokenized(chunk_table(spark, sf_dir))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, pos, score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(chunk_table(spark, sf_dir), query_table(spark, sf_dir)).select("query_id", "pos", "score", "rank")


@query("""WITH pg AS (SELECT page_id AS pos, regexp_extract_all(lower(html), '[a-z0-9]+') AS tokens FROM pages), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM pg),
post AS (SELECT pos, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT pos, tokens, unnest(tokens) AS term FROM pg) GROUP BY pos, tokens, term),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
sc AS (SELECT query_id, pos, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY query_id, pos)
SELECT query_id, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM sc WHERE score > 0) WHERE rank <= 100""")
def bm25_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.col("html").alias("index_text"))
    return lexical.bm25(pages, query_table(spark, sf_dir)).select("query_id", "pos", "score", "rank")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def topk_stable(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), F.col("n_chars").alias("score"))
    return lexical.top_n(scored, 5, "source").select("source", F.col("pos").alias("doc_id"), "rank")


@query(f"WITH {_DENSE} SELECT query_id, pos, score, rank FROM dn")
def dense_topk(spark, sf_dir):
    return ranking.dense(vector_table(spark, sf_dir), vector_queries(spark, sf_dir)).select("query_id", "pos", "score", "rank")


def _fused(spark, sf_dir):
    lexical_ranking = lexical.bm25(chunk_table(spark, sf_dir), query_table(spark, sf_dir))
    dense_ranking = ranking.dense(vector_table(spark, sf_dir), vector_queries(spark, sf_dir))
    return ranking.fuse([lexical_ranking, dense_ranking])


@query(f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT query_id, pos, score, rank FROM rrf")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "pos", "score", "rank")


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_RR} SELECT query_id, pos, score, rank FROM rr")
def rerank_topk(spark, sf_dir):
    return ranking.rerank(_fused(spark, sf_dir), query_table(spark, sf_dir), chunk_table(spark, sf_dir)).select("query_id", "pos", "score", "rank")


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_RR} SELECT query_id, pos, round(score, 3) AS score, rank, before AS fused_place, bm.rank AS bm25_place, dn.rank AS dense_place FROM rr LEFT JOIN (SELECT query_id, pos, rank FROM bm) bm USING (query_id, pos) LEFT JOIN (SELECT query_id, pos, rank FROM dn) dn USING (query_id, pos) WHERE rr.rank <= 10".replace("round(score, 3)", "round(rr.score, 3)").replace("AS score, rank,", "AS score, rr.rank AS rank,"))
def hybrid_search(spark, sf_dir):
    chunks, asked = chunk_table(spark, sf_dir), query_table(spark, sf_dir)
    by_words, by_vector = lexical.bm25(chunks, asked), ranking.dense(vector_table(spark, sf_dir), vector_queries(spark, sf_dir))
    return ranking.hybrid({"bm25": by_words, "dense": by_vector}, asked, chunks).filter("rank <= 10").select(
        "query_id", "pos", F.round("score", 3).alias("score"), "rank", F.col("before").alias("fused_place"), *(F.col("places")[m].alias(f"{m}_place") for m in ("bm25", "dense"))
    )


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_RR} SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT rr.* FROM rr JOIN labels l ON l.doc_id = rr.pos AND l.quality = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8")
def filter_after_rank(spark, sf_dir):
    shortlist = ranking.rerank(_fused(spark, sf_dir), query_table(spark, sf_dir), chunk_table(spark, sf_dir))
    citable = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("pos"))
    return ranking.allowed_after_rank(shortlist, citable, 8)


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_RR} SELECT query_id, pos, rank FROM rr UNION ALL SELECT query_id, pos, rank FROM rrf WHERE rank > 50")
def rerank_order(spark, sf_dir):
    return ranking.rerank(_fused(spark, sf_dir), query_table(spark, sf_dir), chunk_table(spark, sf_dir), keep_tail=True).select("query_id", "pos", "rank")


@query("SELECT a.doc_id AS hit, b.doc_id AS pos FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id - 2 AND a.doc_id + 2 AND a.source = b.source")
def neighbours(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir)
    return ranking.neighbours(chunks, chunks.select("pos"), 2)


@query("SELECT b.item_id, d.doc_id AS pos FROM benchmark b JOIN documents h ON h.doc_id = b.item_id JOIN documents d ON d.source = h.source")
def whole_document(spark, sf_dir):
    wanted = query_table(spark, sf_dir).select(F.col("query_id").alias("pos"))
    return ranking.whole_document(chunk_table(spark, sf_dir), wanted).select(F.col("hit").alias("item_id"), "pos")


# ---- evaluation -------------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    """(query_id, pos) of documents that hold a benchmark item verbatim: they share its rarest token."""
    chunks = lexical.tokenized(chunk_table(spark, sf_dir))
    df = lexical.exploded(chunks, distinct=True).groupBy("term").agg(F.count("*").alias("df"))
    # First and last token of an item may be parts of words in a document; inner tokens are whole.
    asked = query_table(spark, sf_dir).withColumn("tokens", T.tokenize(F.col("text")))
    inner = asked.select("query_id", "text", F.explode(F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(1)))).alias("term")).join(df, "term")
    rarest = inner.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.first("text").alias("item"))
    candidates = lexical.exploded(chunks, "pos", distinct=True).join(rarest, "term").select("pos", "query_id", "item")
    texts = chunk_table(spark, sf_dir).select("pos", "text")
    return texts.join(candidates, "pos").filter(F.col("text").contains(F.col("item"))).select("query_id", "pos")


def _places(spark, sf_dir):
    asked = query_table(spark, sf_dir)
    found = lexical.bm25(chunk_table(spark, sf_dir), asked).withColumnRenamed("pos", "paper").withColumnRenamed("rank", "place")
    return evaluation.places(found, _answers(spark, sf_dir).withColumnRenamed("pos", "paper"), asked)


@query(f"WITH {_PLACES} SELECT query_id, place FROM pl")
def answer_place(spark, sf_dir):
    return _places(spark, sf_dir).select("query_id", "place")


@query(f"WITH {_BM25} SELECT query_id, source AS paper, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS place FROM bm JOIN documents d ON d.doc_id = bm.pos GROUP BY query_id, source")
def paper_ranking(spark, sf_dir):
    papers = chunk_table(spark, sf_dir).select("pos", F.col("document").alias("paper"))
    return evaluation.paper_ranking(lexical.bm25(chunk_table(spark, sf_dir), query_table(spark, sf_dir)), papers)


_METRICS = "mv AS (SELECT query_id, unnest(['hit@1', 'hit@5', 'mrr']) AS metric, unnest([CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END, CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END, CASE WHEN place <= 10 THEN 1.0::DOUBLE / place ELSE 0.0 END]::DOUBLE[]) AS value FROM pl)"


@query(f"WITH {_PLACES}, {_METRICS} SELECT query_id, metric, round(value, 9) AS value FROM mv")
def metric_values(spark, sf_dir):
    return evaluation.metric_values(_places(spark, sf_dir)).select("query_id", "metric", F.round("value", 9).alias("value"))


@query(f"""WITH {_PLACES}, {_METRICS}, v AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM mv),
d AS (SELECT r, k, ('0x' || substr(md5(r || '-' || k), 1, 8))::BIGINT AS h FROM range(1000) t(r), range((SELECT count(*) FROM benchmark)) s(k)),
m AS (SELECT metric, r, avg(value) AS mean FROM d JOIN v ON v.i = d.h % v.n GROUP BY metric, r)
SELECT metric, round((SELECT avg(value) FROM mv x WHERE x.metric = m.metric), 9) AS mean, round(quantile_cont(m.mean, 0.025), 9) AS low, round(quantile_cont(m.mean, 0.975), 9) AS high FROM m GROUP BY metric""")
def eval_summary(spark, sf_dir):
    values = evaluation.metric_values(_places(spark, sf_dir))
    return evaluation.summary(values, ["metric"])


@query(f"""WITH {_PLACES}, {_METRICS}, v AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM mv),
d AS (SELECT r, k, ('0x' || substr(md5(r || '-' || k), 1, 8))::BIGINT AS h FROM range(1000) t(r), range((SELECT count(*) FROM benchmark)) s(k))
SELECT metric, r::BIGINT AS resample, round(avg(value), 9) AS mean FROM d JOIN v ON v.i = d.h % v.n GROUP BY metric, r""")
def bootstrap_ci(spark, sf_dir):
    """The mean of every resample behind the intervals."""
    values = evaluation.numbered(evaluation.metric_values(_places(spark, sf_dir)), ["metric"])
    means = evaluation.resample_means(values.select("metric", "i", "value"), ["metric"])
    return means.select("metric", "resample", F.round("mean", 9).alias("mean"))


# ---- linkage, keepers, vectors ----------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY coalesce(quality, 0) DESC, lang IS NULL, doc_id) AS first FROM documents LEFT JOIN labels USING (doc_id))")
def mark_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("source_file"), F.md5("text").alias("paper_id"), (F.coalesce("quality", F.lit(0)) == 1).alias("citable"), F.col("lang").alias("pmcid"))
    return linkage.mark_duplicates(rows).select(F.col("source_file").alias("doc_id"), "duplicate_of")


@query("SELECT source AS first, arg_max(doc_id, (coalesce(quality, 0), CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END, n_chars, doc_id)) AS best FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def choose_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "jats").when(F.col("lang") == "fr", "grobid").otherwise("markdown")
    rows = docs.select(F.col("source").alias("first"), F.col("doc_id").alias("source_file"), F.coalesce("quality", F.lit(0)).alias("citable"), kind.alias("source"), F.col("n_chars").alias("paragraphs"))
    return linkage.choose_copies(rows)


@query("SELECT title AS title, key FROM (SELECT md5(text) AS title, doc_id AS key, row_number() OVER (PARTITION BY md5(text) ORDER BY coalesce(quality, 0) = 1 DESC, doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id)) WHERE n = 1")
def link_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    entries = docs.select(F.md5("text").alias("title"), F.col("doc_id").alias("key"), (F.coalesce("quality", F.lit(0)) == 1).alias("cited"), F.col("doc_id").alias("pos"))
    return linkage.pick(entries, "title")


@query("SELECT lower(source) AS folded, arg_max(source, doc_id) AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1")
def library_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return linkage.library_keys(docs.select((F.col("quality") == 1).alias("citable"), F.col("source").alias("key"), F.col("doc_id").alias("pos")))


@query("SELECT DISTINCT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id")
def missing_keys_anti(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "left_anti").select("doc_id").distinct()


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_docs_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


_COMMON = ["about", "after", "between"]


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_distinct(string_split({_folded("string_split(text, chr(10))[1]")}, ' ')), lambda x: length(x) >= 5 AND x NOT IN ('about', 'after', 'between')) AS t,
 string_split({_folded("text")}, ' ') AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(t) < 2 THEN 1.0 ELSE len(list_intersect(t, b)) / len(t)::DOUBLE END, 9) AS share FROM w""")
def title_containment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(linkage.title_containment(F.split("text", "\n")[0], F.col("text"), _COMMON), 9).alias("share"))


def _hashed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    header = T.index_header(F.lit(""), F.col("source"))
    return docs.select(F.col("doc_id").alias("pos"), header.alias("header"), F.coalesce("text", F.lit("")).alias("text"), T.text_hash(header, F.coalesce("text", F.lit(""))).alias("text_hash"))


def _stored(spark, sf_dir):
    """A store that holds the labelled documents' texts."""
    return _hashed(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi").select("text_hash").distinct()


_HASHED = "h AS (SELECT doc_id, sha256(source || '.' || chr(10) || text) AS x FROM documents), s AS (SELECT DISTINCT x FROM h JOIN labels USING (doc_id))"


@query(f"WITH {_HASHED} SELECT count(DISTINCT x) FILTER (x NOT IN (SELECT x FROM s)) AS embedded, count(DISTINCT x) FILTER (x IN (SELECT x FROM s)) AS reused FROM h")
def incremental_embed(spark, sf_dir):
    return vectors.reuse_counts(_hashed(spark, sf_dir), _stored(spark, sf_dir))


@query(f"WITH {_HASHED} SELECT count(*) AS missing FROM h WHERE x NOT IN (SELECT x FROM s)")
def missing_vectors(spark, sf_dir):
    return vectors.lacking(_hashed(spark, sf_dir), _stored(spark, sf_dir)).agg(F.count("*").alias("missing"))


@query(f"WITH {_HASHED} SELECT DISTINCT substr(x, 1, 16) AS text_hash, 64 AS dimensions FROM h WHERE x NOT IN (SELECT x FROM s)")
def encode_new_texts(spark, sf_dir):
    return vectors.encode_missing(_hashed(spark, sf_dir), _stored(spark, sf_dir)).select("text_hash", F.size("vector").alias("dimensions"))


# ---- reports and parsers ----------------------------------------------------------------------------------------


# ---- grids of configurations ------------------------------------------------------------------------------------

CONFIGURATIONS = [("bm25",), ("dense",), ("bm25", "dense")]
_CONFIGS = f"""{_BM25}, {_DENSE}, {_RRF},
cr AS MATERIALIZED (SELECT 0 AS config_no, 'bm25' AS config, query_id, pos, rank FROM bm UNION ALL SELECT 1, 'dense', query_id, pos, rank FROM dn UNION ALL SELECT 2, 'bm25+dense', query_id, pos, rank FROM rrf)"""
_GRID = f"""{_CONFIGS}, {_ANSWERS},
cp AS (SELECT config_no, config, item_id AS query_id, min(rank) AS place FROM (SELECT DISTINCT config_no, config FROM cr), benchmark b LEFT JOIN (SELECT cr.config_no AS c, cr.query_id AS q, rank FROM cr JOIN ans USING (query_id, pos)) ON c = config_no AND q = item_id GROUP BY ALL),
gv AS MATERIALIZED (SELECT config_no, config, query_id, unnest(['hit@1', 'hit@5', 'mrr']) AS metric, unnest([CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END, CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END, CASE WHEN place <= 10 THEN 1.0::DOUBLE / place ELSE 0.0 END]::DOUBLE[]) AS value FROM cp)"""


def _configurations(spark, sf_dir):
    by_words = lexical.bm25(chunk_table(spark, sf_dir), query_table(spark, sf_dir))
    by_vector = ranking.dense(vector_table(spark, sf_dir), vector_queries(spark, sf_dir))
    return ranking.configurations({"bm25": by_words, "dense": by_vector}, CONFIGURATIONS)


def _grid_values(spark, sf_dir):
    """(config_no, config, query_id, metric, value) of every configuration and query."""
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("config_no"), F.lit("+".join(c)).alias("config")) for n, c in enumerate(CONFIGURATIONS))))
    asked = query_table(spark, sf_dir).select("query_id", named.alias("c")).select("query_id", "c.*")
    right = _configurations(spark, sf_dir).join(_answers(spark, sf_dir), ["query_id", "pos"])
    found = right.groupBy("config_no", "config", "query_id").agg(F.min("rank").alias("place"))
    return evaluation.metric_values(asked.join(found, ["config_no", "config", "query_id"], "left"))


@query(f"WITH {_CONFIGS} SELECT config, query_id, pos, rank FROM cr")
def config_rankings(spark, sf_dir):
    return _configurations(spark, sf_dir).select("config", "query_id", "pos", "rank")


@query(f"""WITH {_GRID}, g AS (SELECT a.config, a.metric, a.query_id, a.value - b.value AS value FROM gv a JOIN gv b USING (query_id, metric) WHERE b.config = 'bm25' AND a.config <> 'bm25'),
v AS (SELECT config, metric, value, row_number() OVER (PARTITION BY config, metric ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY config, metric) AS n FROM g),
d AS (SELECT r, k, ('0x' || substr(md5(r || '-' || k), 1, 8))::BIGINT AS h FROM range(1000) t(r), range((SELECT count(*) FROM benchmark)) s(k)),
m AS (SELECT config, metric, r, avg(value) AS mean FROM d JOIN v ON v.i = d.h % v.n GROUP BY config, metric, r)
SELECT config, metric, round((SELECT avg(value) FROM g x WHERE x.metric = m.metric AND x.config = m.config), 9) AS mean, round(quantile_cont(m.mean, 0.025), 9) AS low, round(quantile_cont(m.mean, 0.975), 9) AS high FROM m GROUP BY config, metric""")
def paired_difference(spark, sf_dir):
    return evaluation.paired_difference(_grid_values(spark, sf_dir), "bm25")


@query(f"WITH {_GRID} SELECT config, round(avg(value), 9) AS mrr FROM gv WHERE metric = 'mrr' AND contains(config, '+') GROUP BY config_no, config ORDER BY mrr DESC, config_no LIMIT 1")
def best_config(spark, sf_dir):
    return evaluation.best_configuration(_grid_values(spark, sf_dir))


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_RR.replace('f.rank <= 50', 'f.rank <= 100')} SELECT depth, query_id, pos, row_number() OVER (PARTITION BY depth, query_id ORDER BY before > depth, CASE WHEN before <= depth THEN score END DESC, before) AS rank FROM rr, (VALUES (20), (50), (100)) d(depth)")
def rerank_depths(spark, sf_dir):
    return ranking.rerank_depths(_fused(spark, sf_dir), query_table(spark, sf_dir), chunk_table(spark, sf_dir))


# ---- reading in context, articles and books ---------------------------------------------------------------------


@query("SELECT doc_id, coalesce(nullif(source, ''), split_part(text, ' > ', 1)) AS document FROM documents")
def document_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_of(F.nullif("source", F.lit("")), F.lit(None), F.col("text")).alias("document"))


@query()
def latex_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("book"), F.lit(0).alias("pos"), F.concat(F.lit("chapters/"), F.col("doc_id"), F.lit(".tex")).alias("file"), F.col("text").alias("source"))
    return latex.latex_passages(files).select(F.col("book").alias("doc_id"), "chunk_id", "kind", "text", "keys")
