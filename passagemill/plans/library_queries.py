"""Registered queries of chunking, ingestion, linkage and reports, with the SQL that each is checked against.

Files that an operator reads are composed of the tables' rows, as stated in each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import chunking, ingestion, linkage, ranking, reports
from passagemill.plans import queries as Q
from passagemill.plans.queries import query, table
from passagemill.serving import checks
from passagemill.sources import articles, readers

# ---- passages ---------------------------------------------------------------------------------------------------


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _words(text: str) -> str:
    return f"CASE WHEN {_flat(text)} = '' THEN 0 ELSE len(string_split({_flat(text)}, ' ')) END"


def pieces_sql(rows: str, name: str) -> str:
    """CTEs ending in ``name`` (id, q, text): the texts of ``rows`` (id, text) as they enter a passage."""
    n = name
    return f"""{n}_in AS MATERIALIZED (SELECT id, text, {_words('text')} AS n FROM ({rows})),
{n}_u AS (SELECT id, unnest(string_split({_flat('text')}, ' ')) AS word, generate_subscripts(string_split({_flat('text')}, ' '), 1) AS i FROM {n}_in WHERE n > 400),
{n}_p AS (SELECT *, lead(word) OVER (PARTITION BY id ORDER BY i) AS after,
  lower(regexp_replace(regexp_replace(regexp_replace(word, '["''”’)\\]]*$', ''), '^[(\\["''“‘]+', ''), '[.!?]+$', '')) AS core FROM {n}_u),
{n}_b AS (SELECT *, CASE WHEN after IS NOT NULL AND regexp_matches(word, '[.!?]["''”’)\\]]*$') AND NOT regexp_matches(after, '^[a-z]')
  AND core NOT IN {Q._ABBREVIATIONS} AND NOT regexp_full_match(core, '(?:[a-z]\\.)+[a-z]') AND NOT regexp_full_match(core, '\\pL') THEN 1 ELSE 0 END AS ends FROM {n}_p),
{n}_s AS (SELECT id, k, list(word ORDER BY i) AS w FROM (SELECT id, i, word, coalesce(sum(ends) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM {n}_b) GROUP BY id, k),
{n}_c AS (SELECT id, k, w, unnest(range(ceil(len(w) / 300.0)::BIGINT)) AS j, ceil(len(w) / ceil(len(w) / 300.0))::BIGINT AS step FROM {n}_s),
{n}_x AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, j) AS i, w[j * step + 1:(j + 1) * step] AS w, len(w[j * step + 1:(j + 1) * step]) AS sz FROM {n}_c),
{n}_t AS MATERIALIZED (SELECT id, sum(sz) / ceil(sum(sz) / 300.0) AS share FROM {n}_x GROUP BY id),
{n}_f AS (SELECT x.id, x.i, 0 AS piece, CASE WHEN sz >= share THEN 0 ELSE sz END AS cnt, CASE WHEN sz >= share THEN 1 ELSE 0 END AS nxt FROM {n}_x x JOIN {n}_t t USING (id) WHERE x.i = 1
  UNION ALL SELECT id, i, p, CASE WHEN c >= share THEN 0 ELSE c END, CASE WHEN c >= share THEN p + 1 ELSE p END FROM (
    SELECT x.id, x.i, share, CASE WHEN f.cnt > 0 AND f.cnt + x.sz > 300 THEN f.nxt + 1 ELSE f.nxt END AS p, CASE WHEN f.cnt > 0 AND f.cnt + x.sz > 300 THEN x.sz ELSE f.cnt + x.sz END AS c
    FROM {n}_f f JOIN {n}_x x ON x.id = f.id AND x.i = f.i + 1 JOIN {n}_t t ON t.id = x.id)),
{n} AS MATERIALIZED (SELECT id, 0 AS q, text FROM {n}_in WHERE n BETWEEN 1 AND 400
  UNION ALL SELECT f.id, f.piece, string_agg(array_to_string(x.w, ' '), ' ' ORDER BY x.i) FROM {n}_f f JOIN {n}_x x ON x.id = f.id AND x.i = f.i GROUP BY f.id, f.piece)"""


def runs_sql(rows: str, name: str) -> str:
    """CTEs ending in ``name`` (doc, run, and the columns of ``rows`` (doc, i, text, ...)): parts gathered in the order of i, which counts from 1."""
    n = name
    return f"""{n}_in AS MATERIALIZED (SELECT *, {_words('text')} AS sz FROM ({rows})),
{n}_g AS (SELECT doc, i, sz AS total, 0 AS run FROM {n}_in WHERE i = 1
  UNION ALL SELECT w.doc, w.i, CASE WHEN g.total + w.sz > 300 THEN w.sz ELSE g.total + w.sz END, CASE WHEN g.total + w.sz > 300 THEN g.run + 1 ELSE g.run END FROM {n}_g g JOIN {n}_in w ON w.doc = g.doc AND w.i = g.i + 1),
{n} AS MATERIALIZED (SELECT r.*, g.run FROM {n}_in r JOIN {n}_g g USING (doc, i))"""


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents"


@query("WITH RECURSIVE " + pieces_sql("SELECT doc_id AS id, coalesce(text, '') AS text FROM documents", "pc") + f" SELECT id AS doc_id, q::BIGINT AS n, ({_words('text')})::BIGINT AS words, md5(text) AS piece_md5 FROM pc")
def split_long(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.posexplode(chunking.pieces(F.col("text"))).alias("n", "piece"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), T.word_count(F.col("piece")).cast("long").alias("words"), F.md5("piece").alias("piece_md5"))


@query(
    f"WITH RECURSIVE ln AS ({_LINES}), "
    + pieces_sql("SELECT doc_id * 100000 + no AS id, line AS text FROM ln", "pc")
    + ", "
    + runs_sql("SELECT id // 100000 AS doc, row_number() OVER (PARTITION BY id // 100000 ORDER BY id, q) AS i, text FROM pc", "rn")
    + f" SELECT doc, run::BIGINT AS n, ({_words('t')})::BIGINT AS words, md5(t) AS text_md5 FROM (SELECT doc, run, string_agg(text, chr(10) || chr(10) ORDER BY i) AS t FROM rn GROUP BY doc, run)"
)
def chunk_documents(spark, sf_dir):
    """The lines of each document as paragraphs of one section."""
    return chunking.merge_paragraphs(Q._paragraphs(spark, sf_dir)).select("doc", "n", "words", F.md5("text").alias("text_md5"))


@query("WITH RECURSIVE " + pieces_sql(f"SELECT doc_id * 100000 + no AS id, line AS text FROM ({_LINES})", "pc") + " SELECT id // 100000 AS doc_id, (id % 100000 - 1)::BIGINT AS p, q::BIGINT AS q, md5(text) AS piece_md5 FROM pc")
def pieces(spark, sf_dir):
    """Each line of a document as a passage: none if blank, itself, or its pieces."""
    lines = Q._paragraphs(spark, sf_dir).select("doc", F.posexplode("paragraphs").alias("p", "line"))
    cut = lines.select("doc", "p", F.posexplode(chunking.pieces(F.col("line"))).alias("q", "piece"))
    return cut.select(F.col("doc").alias("doc_id"), F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), F.md5("piece").alias("piece_md5"))


@query(
    f"WITH RECURSIVE ln AS ({_LINES}), "
    + pieces_sql("SELECT doc_id * 100000 + no AS id, line AS text FROM ln", "pc")
    + ", "
    + runs_sql("SELECT id // 100000 AS doc, row_number() OVER (PARTITION BY id // 100000 ORDER BY id, q) AS i, 'r' || size % 5 AS cite, text FROM (SELECT l.doc_id * 100000 + l.no AS id, q, length(l.line) AS size, pc.text FROM pc JOIN ln l ON pc.id = l.doc_id * 100000 + l.no)", "rn")
    + """, firsts AS (SELECT doc, run, cite, min(i) AS i FROM rn GROUP BY ALL)
SELECT doc, run::BIGINT AS run, count(*) AS parts, md5(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS text_md5,
  (SELECT string_agg(cite, ',' ORDER BY f.i) FROM firsts f WHERE f.doc = rn.doc AND f.run = rn.run) AS cites FROM rn GROUP BY doc, run"""
)
def join_run(spark, sf_dir):
    """Lines gathered to passages: texts joined, cites once each in order of appearance. A line cites by its length."""
    lines = Q._paragraphs(spark, sf_dir).select("doc", F.posexplode("paragraphs").alias("p", "text"))
    cited = lines.withColumn("cites", F.array(F.concat(F.lit("r"), (F.length("text") % 5).cast("string"))))
    merged = chunking.merge_parts(cited, ["doc"], ["cites"])
    return merged.select("doc", F.col("run").cast("long").alias("run"), F.size("group").cast("long").alias("parts"), F.md5(chunking.joined(F.col("group"))).alias("text_md5"), F.array_join(chunking.merged_cites(F.col("group")), ",").alias("cites"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line is the abstract, the others are paragraphs of two sections, each citing one of three ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    cited = F.transform(rest, lambda x, i: F.struct(x.alias("text"), F.array(F.concat(F.lit("r"), (i % 3).cast("string"))).alias("cites"), i.alias("i")))
    half = lambda k: F.transform(F.filter(cited, lambda x: (x["i"] < 3) == F.lit(k == 0)), lambda x: F.struct(x["text"].alias("text"), x["cites"].alias("cites")))
    section = lambda k: F.struct(F.lit("Methods" if k == 0 else "Results").alias("heading"), half(k).alias("paragraphs"))
    reference = lambda name: F.struct(F.concat("source", F.lit(f" {name}")).alias("text"))
    return docs.select(
        F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("key"), F.lit(True).alias("citable"), F.lit("T").alias("title"), F.lit(2000).alias("year"), F.lit(None).cast("string").alias("doi"),
        F.concat("source", F.lit(".md")).alias("source_file"), F.col("lines")[0].alias("abstract"), F.array(section(0), section(1)).alias("sections"),
        F.array(F.struct(F.lit("Figure 1").alias("label"), F.concat("source", F.lit(" in "), "lang").alias("text"), F.array(F.lit("r1"), F.lit("r2")).alias("cites"))).alias("captions"),
        F.create_map(F.lit("r0"), reference("zero"), F.lit("r1"), reference("one")).alias("references"),
    )


@query(
    f"""WITH RECURSIVE ln AS ({_LINES}), """
    + pieces_sql("SELECT doc_id * 100000 + no AS id, line AS text FROM ln", "pc")
    + """, parts AS (SELECT id // 100000 AS doc_id, id % 100000 - 2 AS p, q, text FROM pc),
"""
    + runs_sql("SELECT doc_id * 2 + (p >= 3)::INT AS doc, row_number() OVER (PARTITION BY doc_id, p >= 3 ORDER BY p, q) AS i, text, p FROM parts WHERE p >= 0", "rn")
    + """, psg AS (
  SELECT doc_id, 0 AS part, 0 AS block, q AS m, 'Abstract' AS section, 'abstract' AS kind, text, '' AS cites FROM parts WHERE p = -1
  UNION ALL SELECT doc // 2, 1, doc % 2, run, CASE WHEN doc % 2 = 0 THEN 'Methods' ELSE 'Results' END, 'body', string_agg(text, chr(10) || chr(10) ORDER BY i),
    array_to_string(list_filter(list_distinct_in_order, lambda x: x <> 'r2'), ',') FROM (SELECT *, list('r' || (p % 3)) OVER w AS l, list_filter(list('r' || (p % 3)) OVER w, lambda x, k: list_position(list('r' || (p % 3)) OVER w, x) = k) AS list_distinct_in_order FROM rn WINDOW w AS (PARTITION BY doc, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY doc, run, list_distinct_in_order
  UNION ALL SELECT doc_id, 2, 0, 0, 'Figure 1', 'caption', source || ' in ' || lang, 'r1' FROM documents)
SELECT doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY part, block, m) - 1) AS chunk_id, section, kind, md5(text) AS text_md5, cites FROM psg"""
)
def chunk_papers(spark, sf_dir):
    found = chunking.chunk_papers(_papers(spark, sf_dir))
    ids = F.transform("cites", lambda r: F.when(r["text"].endswith("zero"), F.lit("r0")).otherwise(F.lit("r1")))
    return found.select("chunk_id", "section", "kind", F.md5("text").alias("text_md5"), F.array_join(ids, ",").alias("cites"))


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes: a heading, then a paragraph for each turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    source = F.concat(F.lit("# Conversation\n\n"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n"))
    return turns.select(F.col("conv_id").cast("string").alias("note"), F.concat("conv_id", F.lit(".md")).alias("file"), source.alias("source"))


@query(
    "WITH RECURSIVE tn AS (SELECT conv_id, turn, text, len(string_split(text, chr(10))) AS height, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), "
    + "ps AS (SELECT *, 3 + coalesce(sum(height + 1) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM tn), "
    + runs_sql("SELECT conv_id AS doc, i, text, low, low + height - 1 AS high FROM ps", "rn")
    + """ SELECT doc || '#' || run AS chunk_id, min(low)::INT AS line_start, max(high)::INT AS line_end, 'Conversation' AS section, md5(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS text_md5,
  substr(sha256(string_agg(text, chr(10) || chr(10) ORDER BY i)), 1, 16) AS hash FROM rn GROUP BY doc, run"""
)
def chunk_notes(spark, sf_dir):
    found = chunking.chunk_notes(_vault(spark, sf_dir))
    return found.select("chunk_id", "line_start", "line_end", "section", F.md5("text").alias("text_md5"), "hash")


@query("SELECT conv_id::VARCHAR AS note, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS n, md5(text) AS text_md5, substr(sha256(text), 1, 16) AS hash FROM conversations")
def note_blocks(spark, sf_dir):
    return readers.note_blocks(_vault(spark, sf_dir)).select("note", "n", F.md5("text").alias("text_md5"), "hash")


_MARKED = "'![[p' || turn || '.png]]> ==' || role || '== [[' || role || '#Head|' || conv_id || ']] [[' || turn || ']] [' || role || '](http://x.y/) [!note]+ text ^ab-' || turn"


@query(f"""WITH m AS (SELECT conv_id, turn, {_MARKED} AS l FROM conversations)
SELECT conv_id, turn, rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '!\\[\\[[^\\]]*\\]\\]', '', 'g'), '\\[\\[[^\\]|]*\\|([^\\]]+)\\]\\]', '\\1', 'g'), '\\[\\[([^\\]|#]*)\\]\\]', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '==([^=]+)==|\\[![^\\]]*\\][+-]?\\s*', '\\1', 'g'), '\\s\\^[A-Za-z0-9-]+$', '')) AS line FROM m""")
def clean_markup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    line = F.concat(F.lit("![[p"), turn, F.lit(".png]]> =="), "role", F.lit("== [["), "role", F.lit("#Head|"), conv, F.lit("]] [["), turn, F.lit("]] ["), "role", F.lit("](http://x.y/) [!note]+ text ^ab-"), turn)
    return rows.select("conv_id", "turn", T.note_line(line).alias("line"))


# ---- text functions that need no more than their rows -----------------------------------------------------------

_NUMBERS = """list_filter(flatten(list_transform(regexp_extract_all(regexp_replace({0}, '([0-9])-', '\\1 - ', 'g'), '(?:^|[^A-Za-z0-9-]|(?:^|[^A-Za-z])-)([0-9]+(?:[.,][0-9]+)*(?:\\^-?[0-9]+)?)', 1), lambda x: string_split(regexp_replace(x, ',([0-9]{{3}})\\b', '\\1', 'g'), ','))), lambda x: x <> '')"""
_DISTINCT = "list_filter(l, lambda x, i: list_position(l, x) = i)"


@query(f"SELECT doc_id, array_to_string({_DISTINCT}, ' ') AS numbers FROM (SELECT doc_id, {_NUMBERS.format('text')} AS l FROM documents)")
def numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


_SHARE = f"""WITH {Q._BM25}, {Q._ANSWERS},
qn AS (SELECT item_id AS query_id, {_NUMBERS.format("text || ' ' || item_id % 10")} AS want FROM benchmark),
pn AS (SELECT bm.query_id, flatten(list({_NUMBERS.format('d.text')})) AS have FROM bm JOIN ans USING (query_id, pos) JOIN documents d ON d.doc_id = bm.pos WHERE bm.rank <= 5 GROUP BY bm.query_id),
nf AS (SELECT query_id, len(list_filter(want, lambda x: NOT list_contains(coalesce(have, []), x))) = 0 AS found FROM qn LEFT JOIN pn USING (query_id) WHERE len(want) > 0)"""


def _number_tables(spark, sf_dir):
    """Each item asks for its numbers and for the last digit of its id."""
    asked = Q.query_table(spark, sf_dir)
    chunks = Q.chunk_table(spark, sf_dir).select("pos", F.col("pos").alias("paper"), "text")
    answers = Q._answers(spark, sf_dir).withColumnRenamed("pos", "paper")
    wanted = asked.select("query_id", T.numbers(F.concat("text", F.lit(" "), F.col("query_id") % 10)).alias("numbers"))
    return Q.lexical.bm25(Q.chunk_table(spark, sf_dir), asked), chunks, answers, wanted


@query(f"{_SHARE} SELECT count(*) AS queries, avg(found::INT) AS share FROM nf")
def number_share(spark, sf_dir):
    return Q.evaluation.number_share(*_number_tables(spark, sf_dir))


@query(f"{_SHARE} SELECT query_id, found FROM nf")
def numbers_found(spark, sf_dir):
    return Q.evaluation.numbers_found(*_number_tables(spark, sf_dir))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(replace(text, '_', chr(57346)), '(?i)\\b(the|and|data)\\b', chr(57344) || '\\1' || chr(57345), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(57344), '<mark>'), chr(57345), '</mark>'), chr(57346), '_') AS html FROM documents""")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.highlight(F.col("text"), ["the", "and", "data"]).alias("html"))


@query(f"SELECT doc_id, no, md5({Q._HEADING_SQL.replace('title', 'line')}) AS heading_md5 FROM ({_LINES})")
def heading_norm(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "no", F.md5(T.heading(F.col("line"))).alias("heading_md5"))


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    return rows.select("doc_id", (F.col("no") + 1).cast("long").alias("no"), "line")


_BOILER = "'" + "|".join(f"(?:{p})" for p in T.BOILERPLATE_HEADINGS).replace("'", "''") + "'"


@query(f"SELECT doc_id, no FROM (SELECT doc_id, no, unnest([line, 'Author contributions: ' || line, '2. References.']) AS line, unnest([0, 1, 2]) AS k FROM ({_LINES})) WHERE NOT regexp_full_match(lower({Q._HEADING_SQL.replace('title', 'line')}), {_BOILER})")
def boilerplate_filter(spark, sf_dir):
    """Each line as a heading, the line behind a boilerplate heading's words, and a boilerplate heading."""
    kinds = F.explode(F.array(F.col("line"), F.concat(F.lit("Author contributions: "), "line"), F.lit("2. References."))).alias("line")
    return _lines(spark, sf_dir).select("doc_id", "no", kinds).filter(~T.is_boilerplate(F.col("line"))).select("doc_id", "no")


_MARKER_SQL = "regexp_full_match(trim(m), '[\\[(]?\\s*\\d+[a-z]?(\\s*[,–\\-−—]\\s*\\d+[a-z]?)*\\s*[\\])]?[\\s,;]*') AND NOT regexp_full_match(trim(m), '[\\[(]?\\s*(?:19|20)\\d{2}[a-z]?\\s*[\\])]?[\\s,;]*')"


@query(f"WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS m FROM documents UNION ALL SELECT doc_id, '[' || doc_id || ', ' || doc_id % 9 || 'a]' FROM documents UNION ALL SELECT doc_id, '(' || 1900 + doc_id % 99 || ')' FROM documents) SELECT doc_id, count(*) AS markers FROM w WHERE {_MARKER_SQL} GROUP BY doc_id")
def numeric_marker(spark, sf_dir):
    """The words of each document, and two markers made of its id, of which one is a year."""
    docs = table(spark, sf_dir, "documents")
    made = F.array(F.concat(F.lit("["), "doc_id", F.lit(", "), F.col("doc_id") % 9, F.lit("a]")), F.concat(F.lit("("), 1900 + F.col("doc_id") % 99, F.lit(")")))
    rows = docs.select("doc_id", F.explode(F.concat(F.split(F.coalesce("text", F.lit("")), " "), made)).alias("m"))
    return rows.filter(T.is_numeric_marker(F.col("m"))).groupBy("doc_id").agg(F.count("*").alias("markers"))


# ---- files and their metadata -----------------------------------------------------------------------------------

_PAPER_FILE = """'# Title of ' || source || '.' || chr(10) || '- Year: ' || (1990 + doc_id % 30) || chr(10) || '- DOI: ' || CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1000/D' || doc_id ELSE 'N/A' END || chr(10)
  || '- Year: ' || (1980 + doc_id % 30) || chr(10) || '## Extracted Full Text' || repeat(chr(10) || '## Page 1' || chr(10) || lang, (doc_id % 4)::INT) || chr(10) || '- Year: 1000'"""


def _paper_file():
    doc = F.col("doc_id")
    return F.concat(
        F.lit("# Title of "), "source", F.lit(".\n- Year: "), 1990 + doc % 30, F.lit("\n- DOI: "), F.when(doc % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/D"), doc)).otherwise(F.lit("N/A")), F.lit("\n- Year: "),
        1980 + doc % 30, F.lit("\n## Extracted Full Text"), F.repeat(F.concat(F.lit("\n## Page 1\n"), "lang"), (doc % 4).cast("int")), F.lit("\n- Year: 1000"),
    )


@query(f"""WITH m AS (SELECT doc_id, {_PAPER_FILE} AS md FROM documents), h AS (SELECT *, string_split(md, '## Extracted Full Text')[1] AS head FROM m)
SELECT doc_id, regexp_extract(head, '(?m)^# (.*)\\.$', 1) AS title, list_last(regexp_extract_all(head, '(?m)^- Year: (.*)$', 1)) AS year, lower(nullif(regexp_extract(head, '10\\.1000/\\S+'), '')) AS doi, len(regexp_extract_all(md, '(?m)^## Page \\d+')) AS pages FROM h""")
def doc_metadata(spark, sf_dir):
    """Each document's fields as the metadata block of a paper: a repeated field, an unknown one, and one after the mark."""
    read = table(spark, sf_dir, "documents").select("doc_id", _paper_file().alias("md")).select("doc_id", "md", readers.metadata(F.col("md")).alias("meta"))
    return read.select("doc_id", F.col("meta")["Title"].alias("title"), F.col("meta")["Year"].alias("year"), T.normalise_doi(F.col("meta")["DOI"]).alias("doi"), readers.page_count(F.col("md")).cast("long").alias("pages"))


@query(f"SELECT doc_id, unnest([0, 1])::BIGINT AS n, md5({Q._TIDY}) AS page_md5 FROM documents WHERE {Q._TIDY} <> ''")
def markdown_pages(spark, sf_dir):
    marked = F.concat(F.lit("# Title\n- Year: 2001\n## Extracted Full Text\n## Page 1\n"), "text", F.lit("\n## Page 2\n"), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(readers.pages(marked)).alias("n", "page"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.md5("page").alias("page_md5"))


@query("SELECT source, unnest(list_distinct(list(lower(source || 'Key' || doc_id % 50)))) AS key FROM documents GROUP BY source")
def cited_keys(spark, sf_dir):
    """A reference list per source, with an item for each document."""
    item = F.concat(F.lit("\\bibitem[Au"), "doc_id", F.lit("]{"), "source", F.lit("Key"), F.col("doc_id") % 50, F.lit("}\nAuthor {2001}."))
    lists = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.collect_list(item), "\n").alias("bbl"))
    return lists.select("source", F.explode(readers.cited_keys(F.col("bbl"))).alias("key"))


@query("SELECT source, 'Summary ' || doc_id || '.' AS summary, lang || '|' || 'k' || doc_id % 7 AS keys FROM documents WHERE doc_id % 5 <> 0")
def index_entries(spark, sf_dir):
    """A paragraph index per source: an entry for each document, every fifth without keys."""
    entry = F.concat(F.lit("- `L"), "doc_id", F.lit("-9` — Summary "), "doc_id", F.lit("."), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" Cites: "), "lang", F.lit(", k"), F.col("doc_id") % 7, F.lit("."))).otherwise(F.lit("")))
    lists = table(spark, sf_dir, "documents").groupBy("source").agg(F.concat(F.lit("# Index\n"), F.array_join(F.collect_list(entry), "\n")).alias("md"))
    return lists.select("source", F.explode(readers.index_entries(F.col("md"))).alias("e")).select("source", "e.summary", F.array_join("e.keys", "|").alias("keys"))


@query("""SELECT doc_id AS pos, 'K' || doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN '10.1000/a' || doc_id END AS doi, trim(regexp_replace(lower('Notes of ' || source), '[^a-z0-9]+', ' ', 'g')) AS title, (1900 + doc_id % 100)::INT AS year, doc_id % 3 = 0 AS cited FROM documents""")
def bib_entries(spark, sf_dir):
    """An entry for each document: the DOI as a field, as an address or absent, the year in a date, braces in the title; every third is cited."""
    docs = table(spark, sf_dir, "documents")
    doi = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("doi = {10.1000/A"), "doc_id", F.lit("},"))).when(F.col("doc_id") % 2 == 0, F.concat(F.lit('url = "https://doi.org/10.1000/a'), "doc_id", F.lit('",'))).otherwise(F.lit("url = {http://x.y/10.1000/no},"))
    entry = F.concat(F.lit("@comment{x}\n@article{K"), "doc_id", F.lit(", title = {Notes of\n  {"), "source", F.lit("}}, "), doi, F.lit(" date = "), 1900 + F.col("doc_id") % 100, F.lit("-07-01, title = {Other} }"))
    bbl = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("\\bibitem{k"), "doc_id", F.lit("}")).alias("text"))
    found = readers.bib_entries(docs.select(entry.alias("text")), bbl)
    return found.select(F.substring("key", 2, 20).cast("long").alias("pos"), "key", "doi", "title", "year", "cited")


@query("SELECT doc_id, lang, source FROM documents")
def scan_jsonl(spark, sf_dir):
    """Rows written as JSON lines and parsed again by the schema of a collection."""
    lines = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "source")).alias("line"))
    return lines.select(F.from_json("line", "doc_id long, lang string, source string").alias("r")).select("r.*")


# ---- linkage and ingestion --------------------------------------------------------------------------------------

_TITLE = "trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_partkey), '[^a-z0-9]+', ' ', 'g'))"


def _part_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.normalise_title(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), F.col("p_partkey").cast("string"))).alias("title"))


@query(f"SELECT p_partkey AS record, p_partkey AS key, round(2.0 * length({_TITLE}) / (2 * length({_TITLE}) + 1), 9)::DOUBLE AS ratio FROM part WHERE length({_TITLE}) >= 19")
def similar_title(spark, sf_dir):
    """Every part name with a letter added against all part names: nothing is as near as the name itself."""
    parts = _part_titles(spark, sf_dir)
    entries = parts.select("key", F.lit(False).alias("cited"), F.col("key").alias("pos"), "title")
    return linkage.similar_titles(parts.select(F.col("key").alias("record"), F.concat("title", F.lit("s")).alias("title")), entries).select("record", "key", F.round("ratio", 9).alias("ratio"))


@query(f"SELECT p_partkey AS record, CASE WHEN matched_by IS NOT NULL THEN p_partkey END AS key, matched_by FROM (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'doi' WHEN p_partkey % 2 = 0 THEN 'title' WHEN length({_TITLE}) >= 19 THEN 'similar title' END AS matched_by FROM part)")
def link_cascade(spark, sf_dir):
    """Every part: an eighth by DOI under another title, the other even ones by title, odd ones with a letter added."""
    parts = _part_titles(spark, sf_dir).withColumn("doi", F.when(F.col("key") % 8 == 0, F.concat(F.lit("10.1000/p"), "key")))
    entries = parts.select("key", "doi", "title", F.lit(False).alias("cited"), F.col("key").alias("pos"))
    title = F.when(F.col("key") % 8 == 0, F.lit("another title altogether")).when(F.col("key") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit("s")))
    return linkage.link_cascade(parts.select(F.col("key").alias("record"), "doi", title.alias("title")), entries)


@query("SELECT o_orderkey AS record, min(c_custkey) AS key FROM orders JOIN customer ON c_nationkey = o_custkey % 25 GROUP BY o_orderkey")
def link_exact(spark, sf_dir):
    """Orders against customers by a DOI that all customers of a nation share: the first of them is picked."""
    made = lambda c: F.concat(F.lit("10.1000/n"), c.cast("string"))
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), made(F.col("c_nationkey")).alias("doi"), F.lit(False).alias("cited"), F.col("c_custkey").alias("pos"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), made(F.col("o_custkey") % 25).alias("doi"))
    return records.join(linkage.pick(entries, "doi"), "doi").select("record", "key")


_PAIR_KEYS = "k AS (SELECT lower(source) AS folded, arg_max(source, doc_id) AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)"


@query(f"""WITH {_PAIR_KEYS}, s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no, source FROM documents WHERE doc_id % 3 <> 0)
SELECT chunk_id, position, md5(line) AS query_md5, key FROM (SELECT doc_id::VARCHAR AS chunk_id, no::BIGINT AS position, line, key, row_number() OVER (PARTITION BY line, key ORDER BY doc_id, no) AS n FROM s JOIN k ON folded = lower(source)) WHERE n = 1""")
def make_pairs(spark, sf_dir):
    """Lines as sentences that cite their document's source in another case; every third document's cite two keys."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("no", "text"))
    keys = F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("other"))).otherwise(F.array(F.upper("source")))
    sentences = lines.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("pos"), (F.col("no") + 1).cast("long").alias("position"), "text", keys.alias("keys"))
    return linkage.make_pairs(sentences, Q.library_keys(spark, sf_dir)).select("chunk_id", "position", F.md5("query").alias("query_md5"), "key")


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(lower('S' || l_suppkey)))) AS k FROM lineitem GROUP BY 1), one AS (SELECT k, min(id) AS right_id FROM s GROUP BY k HAVING count(*) = 1)
SELECT s.id AS left_id, right_id FROM s JOIN one USING (k)""")
def set_equality_join(spark, sf_dir):
    """Orders by the set of their suppliers."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.concat(F.lit("S"), "l_suppkey")).alias("keys"))
    return linkage.set_equality(sets.withColumnRenamed("id", "left_id"), sets.withColumnRenamed("id", "right_id"))


@query("""WITH f AS (SELECT doc_id, source || ' ' || (1990 + doc_id % 30) || ' - Work ' || doc_id || CASE WHEN doc_id % 11 = 0 THEN ' SUPPL' ELSE '' END AS stem FROM documents),
m AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'E1' WHEN doc_id % 3 = 0 THEN 'E' || doc_id WHEN doc_id % 2 = 0 AND doc_id % 11 <> 0 THEN 'E' || doc_id END AS key FROM f)
SELECT stem || '.md' AS source_file, CASE WHEN key IS NULL THEN stem ELSE key || CASE WHEN doc_id % 11 = 0 THEN '-supplement' ELSE '' END END AS paper_id, key,
  CASE WHEN doc_id % 10 = 0 THEN 'override' WHEN doc_id % 3 = 0 THEN 'doi' WHEN key IS NOT NULL THEN 'title' END AS matched_by, CASE WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 THEN 'jats' ELSE 'grobid' END AS route, (1990 + doc_id % 30)::INT AS year FROM m""")
def manifest_rows(spark, sf_dir):
    """A file for each document: every tenth is overridden, every third has a DOI, even ones a title that the bibliography has."""
    doc = F.col("doc_id")
    stem = F.concat("source", F.lit(" "), 1990 + doc % 30, F.lit(" - Work "), doc, F.when(doc % 11 == 0, F.lit(" SUPPL")).otherwise(F.lit("")))
    head = F.concat(F.lit("# x\n- PMCID: "), F.when(doc % 5 == 0, F.concat(F.lit("pmc"), doc)).otherwise(F.lit("N/A")), F.lit("\n- DOI: "), F.when(doc % 3 == 0, F.concat(F.lit("10.1000/w"), doc)).otherwise(F.lit("N/A")), F.lit("\n"))
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(stem, F.lit(".md")).alias("source_file"), head.alias("text"))
    entries = docs.select(F.concat(F.lit("E"), doc).alias("key"), F.concat(F.lit("10.1000/w"), doc).alias("doi"), F.when(doc % 2 == 0, F.concat(F.lit("work "), doc)).otherwise(F.lit("")).alias("title"), F.lit(False).alias("cited"), doc.alias("pos"))
    overrides = docs.filter("doc_id % 10 = 0").select(F.concat(stem, F.lit(".md")).alias("source_file"), F.lit("E1").alias("key"))
    rows = ingestion.manifest(files, spark.createDataFrame([], "pdf_file string"), entries, overrides, [])
    return rows.select("source_file", "paper_id", "key", "matched_by", "route", "year")


@query("""WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first, CASE WHEN doc_id % 2 = 0 THEN source END AS key FROM documents)
SELECT d.doc_id, coalesce(d.key, CASE WHEN d.first <> d.doc_id THEN coalesce(f.key, 'p' || f.doc_id) END, 'p' || d.doc_id) AS paper FROM d JOIN d f ON f.doc_id = d.first""")
def file_papers(spark, sf_dir):
    """Documents as files; equal texts are copies of the first."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first"))
    rows = docs.withColumn("h", F.md5("text")).join(first, "h").select(
        F.col("doc_id").alias("source_file"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("key"), F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.when(F.col("first") != F.col("doc_id"), F.col("first")).alias("duplicate_of")
    )
    return ingestion.file_papers(rows).select(F.col("source_file").alias("doc_id"), "paper")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'jats' WHEN doc_id % 3 = 0 THEN 'grobid' ELSE 'markdown' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'j' || doc_id WHEN doc_id % 3 = 0 THEN 't' || doc_id END AS path FROM documents")
def choose_source(spark, sf_dir):
    doc = F.col("doc_id")
    paths = table(spark, sf_dir, "documents").select("doc_id", F.when(doc % 2 == 0, F.concat(F.lit("j"), doc)).alias("jats"), F.when(doc % 3 == 0, F.concat(F.lit("t"), doc)).alias("tei"))
    return paths.select("doc_id", ingestion.choose_source(F.col("jats"), F.col("tei")).alias("s")).select("doc_id", "s.source", "s.path")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'K' || doc_id WHEN doc_id % 3 = 0 THEN 'L' || doc_id ELSE 'stem' || doc_id END AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'K' || doc_id WHEN doc_id % 3 = 0 THEN 'L' || doc_id END AS key,
  CASE WHEN doc_id % 5 = 0 THEN 'parsed ' || doc_id ELSE 'row ' || doc_id END AS title, CASE WHEN doc_id % 7 = 0 THEN 2000 ELSE 1990 END AS year FROM documents""")
def paper_record(spark, sf_dir):
    """Manifest rows and parsed texts: odd documents have no key, and every third finds one by the parsed DOI."""
    docs, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    key = F.when(doc % 2 == 0, F.concat(F.lit("K"), doc))
    none = F.lit(None).cast("string")
    rows = docs.select(F.coalesce(key, F.concat(F.lit("stem"), doc)).alias("paper_id"), key.alias("key"), key.isNotNull().alias("citable"), F.concat(F.lit("row "), doc).alias("title"), F.when(doc % 7 == 0, F.lit(2000)).alias("year"), none.alias("doi"), none.alias("pmid"), none.alias("pmcid"), doc.cast("string").alias("source_file"), none.alias("duplicate_of"))
    parsed = docs.select(doc.cast("string").alias("source_file"), F.when(doc % 5 == 0, F.lit("jats")).otherwise(F.lit("grobid")).alias("source"), F.concat(F.lit("parsed "), doc).alias("title"), F.lit(1990).alias("year"), F.concat(F.lit("10.1000/l"), doc).alias("doi"), none.alias("pmid"), none.alias("pmcid"), F.lit("").alias("abstract"), F.array().alias("sections"), F.array().alias("captions"), F.array().alias("reference_ids"), F.create_map(F.lit("a"), F.lit("b")).alias("references"))
    entries = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("L"), doc).alias("key"), F.concat(F.lit("10.1000/l"), doc).alias("doi"), F.lit("").alias("title"), F.lit(False).alias("cited"), doc.alias("pos"))
    return ingestion.papers(rows, parsed, entries, []).select(F.col("source_file").cast("long").alias("doc_id"), "paper_id", "key", "title", "year")


# ---- articles ---------------------------------------------------------------------------------------------------

_PARAGRAPHS = "SELECT doc_id, list(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS p FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '' GROUP BY doc_id"
_ARTICLE = f"""SELECT doc_id, coalesce(len(p), 0) + 1 AS paragraphs, CASE WHEN len(p) > 0 THEN 'Text;Text > Inner' ELSE 'Text > Inner' END AS headings, 'Seen.' AS last, 'r1,r2,r3' AS cited, 'Caption of ' || source AS caption,
  'Roe J. On ' || source || '. Journal. 2001;4:5–9' AS reference, '10.1000/ab' AS doi FROM documents LEFT JOIN ({_PARAGRAPHS}) USING (doc_id)"""


def _paragraph_marks(text, wrap):
    safe = T.escape_html(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.array_join(F.transform(F.split(safe, "\n"), lambda line: F.concat(F.lit(f"<{wrap}>"), line, F.lit(f"</{wrap}>"))), "")


def _article_rows(found: DataFrame) -> DataFrame:
    paragraphs = F.flatten(F.transform("sections", lambda s: s["paragraphs"]))
    return found.select(
        F.col("source_file").cast("long").alias("doc_id"), F.size(paragraphs).cast("long").alias("paragraphs"), F.array_join(F.transform("sections", lambda s: s["heading"]), ";").alias("headings"),
        F.element_at(paragraphs, -1)["text"].alias("last"), F.array_join(F.element_at(paragraphs, -1)["cites"], ",").alias("cited"), F.col("captions")[0]["text"].alias("caption"),
        F.col("references")["r2"]["text"].alias("reference"), F.col("references")["r1"]["doi"].alias("doi"),
    )


@query(_ARTICLE)
def parse_jats(spark, sf_dir):
    """Each document as an article: its lines are paragraphs, then a subsection with a range of citations, a figure, and references in two forms."""
    docs = table(spark, sf_dir, "documents")
    refs = F.concat(
        F.lit('<ref id="r1"><mixed-citation>Printed <pub-id pub-id-type="doi">https://doi.org/10.1000/AB</pub-id></mixed-citation></ref><ref id="r2"><element-citation><name><surname>Roe</surname><given-names>J</given-names></name><article-title>On '), T.escape_html(F.col("source")),
        F.lit('</article-title><source>Journal</source><year>2001</year><volume>4</volume><fpage>5</fpage><lpage>9</lpage></element-citation></ref><ref id="r3"><mixed-citation>Third</mixed-citation></ref>'),
    )
    inner = F.lit('<sec><title>2.1 Inner.</title><p>Seen<sup><xref ref-type="bibr" rid="r1">1</xref>–<xref ref-type="bibr" rid="r3">3</xref></sup>.</p></sec><sec><title>Acknowledgements</title><p>Thanks</p></sec>')
    figure = F.concat(F.lit("<fig><label>Fig 1</label><caption><p>Caption of "), T.escape_html(F.col("source")), F.lit("</p></caption></fig>"))
    xml = F.concat(F.lit("<article><front><article-meta/></front><body><sec><title>1. Text</title>"), _paragraph_marks(F.col("text"), "p"), inner, figure, F.lit("</sec></body><back><ref-list>"), refs, F.lit("</ref-list></back></article>"))
    return _article_rows(articles.parse_articles(docs.select(F.col("doc_id").cast("string").alias("source_file"), xml.cast("binary").alias("content")), "jats"))


@query(_ARTICLE.replace("'Caption of ' || source", "'Caption of the source ' || source").replace("Text;Text > Inner", "Text;Inner").replace("'Text > Inner'", "'Inner'").replace("'r1,r2,r3'", "'r1,r2,r3'"))
def parse_tei(spark, sf_dir):
    """The same as TEI: flat divisions, a labelled figure, references with a raw text and with fields."""
    docs = table(spark, sf_dir, "documents")
    refs = F.concat(
        F.lit('<biblStruct xml:id="r1"><idno type="DOI">10.1000/AB</idno><note type="raw_reference">Printed</note></biblStruct><biblStruct xml:id="r2"><analytic><title>On '), T.escape_html(F.col("source")),
        F.lit('</title><author><persName><forename>Jane</forename><surname>Roe</surname></persName></author></analytic><monogr><title>Journal</title><imprint><biblScope unit="volume">4</biblScope><biblScope unit="page" from="5" to="9"/><date when="2001-02"/></imprint></monogr></biblStruct><biblStruct xml:id="r3"><note type="raw_reference">Third</note></biblStruct>'),
    )
    inner = F.lit('<div><head n="2">Inner</head><p>Seen <ref type="bibr" target="#r1">[1]</ref>–<ref type="bibr" target="#r3">[3]</ref>.</p></div><div><head>Acknowledgements</head><p>Thanks</p></div>')
    figure = F.concat(F.lit("<figure><head>Figure 1</head><label>1</label><figDesc>Fig. 1. Caption of the source "), T.escape_html(F.col("source")), F.lit("</figDesc></figure>"))
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body><div><head n="1">Text</head>'), _paragraph_marks(F.col("text"), "p"), F.lit("</div>"), inner, figure, F.lit("</body><back><div><listBibl>"), refs, F.lit("</listBibl></div></back></text></TEI>"))
    return _article_rows(articles.parse_articles(docs.select(F.col("doc_id").cast("string").alias("source_file"), xml.cast("binary").alias("content")), "tei"))


# ---- reports and checks -----------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS kind, count(*) AS papers, median(doc_id % 5) AS sections, median(len(string_split(text, chr(10)))) AS paragraphs, median(doc_id % 7) AS "references",
  round(sum(doc_id % 2) / greatest(sum(len(string_split(text, chr(10)))), 1), 9) AS citing, round(sum(CASE WHEN doc_id % 7 > 3 THEN 3 ELSE 0 END) / greatest(sum(doc_id % 7), 1), 9) AS with_doi FROM (SELECT doc_id, text, nullif(source, 'src0') AS source FROM documents) GROUP BY ROLLUP (source)""")
def ingest_report_rollup(spark, sf_dir):
    """Documents as papers; one source is unknown and keeps a row of its own."""
    doc = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.nullif("source", F.lit("src0")).alias("source"), (doc % 5).alias("sections"), F.size(F.split("text", "\n")).alias("paragraphs"), (doc % 2).alias("citing"), (doc % 7).alias("references"), F.when(doc % 7 > 3, F.lit(3)).otherwise(F.lit(0)).alias("dois"))
    return reports.ingest_report(rows)


@query(f"""WITH w AS (SELECT lang, ({_words('text')}) AS n FROM documents)
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS kind, count(*) AS chunks, median(n) AS median_words, round(avg(CASE WHEN n BETWEEN 150 AND 400 THEN 1.0 ELSE 0.0 END), 9) AS within, round(avg(CASE WHEN n < 150 THEN 1.0 ELSE 0.0 END), 9) AS short, round(avg(CASE WHEN n > 400 THEN 1.0 ELSE 0.0 END), 9) AS long FROM w GROUP BY ROLLUP (lang)""")
def chunk_report_rollup(spark, sf_dir):
    return reports.chunk_report(table(spark, sf_dir, "documents"), "lang")


@query(f"""WITH c AS (SELECT conv_id, ({_words('text')}) AS n FROM conversations WHERE conv_id % 4 <> 0)
SELECT count(*) AS passages, count(DISTINCT conv_id) AS notes, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 = 0) AS empty, median(n) AS median_words, round(avg(CASE WHEN n < 50 THEN 1.0 ELSE 0.0 END), 9) AS short FROM c""")
def notes_report(spark, sf_dir):
    """Conversations as notes, turns as passages; every fourth note has none."""
    rows = table(spark, sf_dir, "conversations").withColumn("note", F.col("conv_id"))
    return reports.notes_report(rows, rows.filter("conv_id % 4 <> 0"))


@query("SELECT d.doc_id::VARCHAR AS source_file FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def freshness_anti(spark, sf_dir):
    names = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").cast("string").alias("source_file"))
    return checks.waiting(names("documents"), names("labels"))


@query(f"WITH {Q._BM25}, {Q._DENSE} SELECT 'bm25' AS method, query_id, pos, rank FROM bm UNION ALL SELECT 'dense', query_id, pos, rank FROM dn")
def batch_rankings(spark, sf_dir):
    by_words = Q.lexical.bm25(Q.chunk_table(spark, sf_dir), Q.query_table(spark, sf_dir))
    return ranking.batch_rankings({"bm25": by_words, "dense": ranking.dense(Q.vector_table(spark, sf_dir), Q.vector_queries(spark, sf_dir))})


@query(f"WITH {Q._BM25}, {Q._DENSE}, {Q._RRF}, {Q._RR} SELECT query_id, pos, score FROM rr")
def rerank_cache(spark, sf_dir):
    """Scores of the fused shortlist, those of even passages from a cache."""
    texts = Q.chunk_table(spark, sf_dir).select("pos", F.col("index_text").alias("passage"))
    pairs = Q._fused(spark, sf_dir).filter("rank <= 50").select("query_id", "pos").join(Q.query_table(spark, sf_dir).select("query_id", F.col("text").alias("query")), "query_id").join(texts, "pos")
    nothing = spark.createDataFrame([], "pair_hash string, score double")
    cache = ranking.cached_scores(pairs.filter("pos % 2 = 0"), nothing)[1]
    return ranking.cached_scores(pairs, cache)[0].select("query_id", "pos", "score")


@query("SELECT vec_id AS pos, len(embedding) AS dimensions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 2 = 0")
def load_vectors(spark, sf_dir):
    """Even vectors as the chunks that ask for theirs, all as the store."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), T.fingerprint(F.concat(F.lit("v"), "vec_id")).alias("text_hash"), F.col("embedding").alias("vector"))
    found = Q.vectors.load_vectors(stored.filter("pos % 2 = 0").select("pos", "text_hash"), stored.select("text_hash", "vector"))
    return found.select("pos", F.size("vector").cast("long").alias("dimensions"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))
