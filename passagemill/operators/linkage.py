"""Linking records, marking duplicates, and key checks."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.shipping import ship_package

TITLE_SIMILARITY, MIN_TITLE = 0.92, 20
#: Titles of a block, on average; a block of records is compared with a block of entries in one task, _ROWS records at a time.
_BLOCK, _ROWS = 4096, 256
#: Titles of more characters are not looked up with one character left out, which costs the square of their length; they are compared in blocks.
_LONGEST = 500
#: Classes that characters are counted in (ASCII ones apart) and the count up to which each class is compared by itself.
_CHARACTERS, _LEVELS = 128, 32

_written: list[str] = []


def pick(candidates: DataFrame, by: str) -> DataFrame:
    """(by, key): among entries (by, key, cited, pos) of one value a cited one if there is one, else the first."""
    order = Window.partitionBy(by).orderBy(F.desc("cited"), "pos")
    return candidates.filter(F.col(by).isNotNull() & (F.col(by) != "")).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(by, "key")


def _common_characters(a: list[str], b: list[str]) -> np.ndarray:
    """At least the characters that each of ``a`` has in common with each of ``b``, as multisets.

    Counts are written in unary, so that the sum of their minima is a matrix
    product; what lies beyond _LEVELS of one character is added as one sum.
    """
    counts = [np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype="<u4") % _CHARACTERS, minlength=_CHARACTERS) for t in side]) for side in (a, b)]
    most = np.minimum(np.minimum(counts[0].max(axis=0), counts[1].max(axis=0)), _LEVELS)
    columns, levels = np.repeat(np.arange(_CHARACTERS), most), np.concatenate([np.arange(1, m + 1) for m in most])
    unary = [(c[:, columns] >= levels).astype(np.float32) for c in counts]
    beyond = [np.maximum(c - _LEVELS, 0).sum(axis=1) for c in counts]
    return np.rint(unary[0] @ unary[1].T).astype(np.int64) + np.minimum.outer(*beyond)


def closest_titles(a: list[str], b: list[str], threshold: float) -> list[tuple[str, str, float]]:
    """(x, y, ratio) for each x of ``a`` and the y of ``b``, all that tie, with its highest ratio of at least ``threshold``."""
    found, lengths = [], np.array([len(y) for y in b])
    for low in range(0, len(a), _ROWS):
        some = a[low : low + _ROWS]
        bound = 2.0 * _common_characters(some, b) / (np.array([len(x) for x in some])[:, None] + lengths)
        for x, limits in zip(some, bound, strict=True):
            near = np.flatnonzero(limits >= threshold)
            best, ties = threshold, []
            for k in near[np.argsort(-limits[near], kind="stable")]:
                if limits[k] < best:
                    break
                ratio = SequenceMatcher(None, x, b[k], autojunk=False).ratio()
                if ratio > best:
                    best, ties = ratio, []
                if ratio == best:
                    ties.append(b[k])
            found += [(x, y, best) for y in ties]
    return found


def _blocks(titles: DataFrame, band: Column) -> tuple[DataFrame, dict[int, int]]:
    """Titles with their length band and block, and the number of blocks of each band."""
    titles = titles.select("title").withColumn("band", band)
    blocks = {r["band"]: -(-r["count"] // _BLOCK) for r in titles.groupBy("band").count().collect()}
    return titles, blocks


def _stored(rows: DataFrame) -> DataFrame:
    """``rows``, written once as Parquet below spark.checkpoint.dir and read again.

    Without that folder a temporary one is used on a local master; on any other
    the rows stay as they are, to be computed at each use.
    """
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            return rows
        local = tempfile.mkdtemp(prefix="passagemill-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
    rows.write.parquet(path := f"{folder}/titles-{uuid.uuid4().hex}")
    _written.append(path)
    return spark.read.schema(rows.schema).parquet(path)


def release_stored(spark: SparkSession) -> None:
    """Delete all tables that similar titles were sought in; call it once the results have been stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def _without_one(titles: DataFrame, hashed: str) -> DataFrame:
    """(``hashed``, short): the hash of each title with that of every string that is the title less one character.

    Of a run of equal characters any one leaves the same string, so only the
    first is left out.
    """
    at = titles.select(hashed, "title", F.explode(F.sequence(F.lit(1), F.length("title"))).alias("at"))
    first = (F.col("at") == 1) | (F.substring("title", F.col("at"), F.lit(1)) != F.substring("title", F.col("at") - 1, F.lit(1)))
    return at.filter(first).select(hashed, F.xxhash64(F.overlay("title", F.lit(""), F.col("at"), F.lit(1))).alias("short"))


def _at_most_one_off(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): every title of ``left`` up to _LONGEST with every one of ``right`` that is equal or has one character more or less.

    Titles meet by 64-bit hashes; a collision adds a pair that is further off.
    """
    a = left.filter(F.length("title") <= _LONGEST).select("title", F.xxhash64("title").alias("x"))
    b = right.select("title", F.xxhash64("title").alias("y"))
    longer = b.filter(F.length("title").between(MIN_TITLE + 1, _LONGEST + 1))
    # Sizes are estimated from files, in which such columns shrink much and titles are not yet taken apart, so nothing may be broadcast by them.
    of_a, of_b = a.withColumnRenamed("title", "a").hint("shuffle_hash"), b.withColumnRenamed("title", "b").hint("shuffle_hash")
    less = a.select("x", F.col("x").alias("y")).unionByName(_without_one(a, "x").withColumnRenamed("short", "y")).join(of_b, "y").join(of_a, "x")
    more = _without_one(longer, "y").withColumnRenamed("short", "x").join(of_a, "x").join(of_b, "y")
    return less.select("a", "b").unionByName(more.select("a", "b"))


def _compared(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b, ratio) as of ``closest_titles``, block by block; None if ``left`` has no rows."""
    spark = left.sparkSession
    band = F.floor(F.log(F.length("title").cast("double")) / math.log((2 - threshold) / threshold + 1e-6)).cast("int")
    left, left_blocks = _blocks(left, band)
    if not left_blocks:
        return None
    right, right_blocks = _blocks(right, band)
    # Each (band of the record, band of the entry, block of the record, block of the entry) is one group.
    groups = [(p, q, i, j) for p in left_blocks for q in (p - 1, p, p + 1) for i in range(left_blocks[p]) for j in range(right_blocks.get(q, 0))]

    def dealt(titles: DataFrame, blocks: dict[int, int], own: str, block: str) -> DataFrame:
        named = F.broadcast(spark.createDataFrame([(n, *g) for n, g in enumerate(groups)], "g long, p int, q int, i int, j int"))
        size = F.broadcast(spark.createDataFrame(list(blocks.items()), "band int, blocks int"))
        at = titles.join(size, "band").select("title", F.col("band").alias(own), F.pmod(F.xxhash64("title"), F.col("blocks")).cast("int").alias(block))
        return at.join(named, [own, block]).select("g", "title")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = closest_titles(a["title"].tolist(), b["title"].tolist(), threshold) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["a", "b", "ratio"]).astype({"a": object, "b": object, "ratio": float})

    return dealt(left, left_blocks, "p", "i").groupBy("g").cogroup(dealt(right, right_blocks, "q", "j").groupBy("g")).applyInPandas(compare, "a string, b string, ratio double")


def _most_similar(titles: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(title, key, ratio), one row for each title of ``titles`` that has a similar entry."""
    ship_package(titles.sparkSession)

    def rate(batches):
        for rows in batches:
            yield rows.assign(ratio=[SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(rows["a"], rows["b"], strict=True)])

    left = _stored(titles.select("title").filter(F.length("title") >= MIN_TITLE).distinct())
    right = _stored(entries.select("title").filter(F.length("title") > 0).distinct())
    # A title two or more characters off has a ratio of at most 2 n / (2 n + 2), that of n + 2 characters which hold all n of the record's.
    size = F.length("a")
    rated = _at_most_one_off(left, right).mapInPandas(rate, "a string, b string, ratio double").filter((F.col("ratio") >= threshold) & (F.col("ratio") > size / (size + 1)))
    near = _stored(rated)
    size = F.length("title")
    rest = left.join(near.select(F.col("a").alias("title")).hint("merge"), "title", "left_anti").filter((size > _LONGEST) | (size / (size + 1) >= threshold))
    others = _compared(rest, right, threshold)
    near = near if others is None else near.unionByName(others)
    one = Window.partitionBy("b").orderBy(F.desc("cited"), "pos")
    named_entries = entries.select("key", "cited", "pos", F.col("title").alias("b")).withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    best = Window.partitionBy("a").orderBy(F.desc("ratio"), F.desc("cited"), "pos")
    return near.join(named_entries.hint("merge"), "b").withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(F.col("a").alias("title"), "key", "ratio")


def similar_titles(records: DataFrame, entries: DataFrame, threshold: float = TITLE_SIMILARITY) -> DataFrame:
    """(record, key, ratio): the entry most similar to each title by the Ratcliff-Obershelp ratio, at least ``threshold``.

    Entries that equal a title, or have one character more or less, are found
    by joins, and settle it if nothing further off can reach the best of them.
    Only the other titles are held against all entries: the ratio is
    2 * matches / (len + len), so partners lie within a length band, here the
    own or a neighbouring step of a geometric scale, and have at least as many
    characters in common as the ratio has matches. Every pair of distinct
    titles of such bands is held against that bound, block by block; the ratio
    is computed in falling order of the bound until no other entry can reach
    the best. No similar pair is lost.
    """
    records, entries = _stored(records.select("record", "title")), _stored(entries.select("key", "cited", "pos", "title"))
    return records.join(_most_similar(records, entries, threshold).hint("merge"), "title").select("record", "key", "ratio")


def _with_key(rows: DataFrame, by: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with the key of their ``by`` in ``keys`` (by, key) as ``name``, or null; rows without a value are dealt out by their record."""
    # One column: Spark would take a constant second one out of the join, and with it the dealing out.
    blank = F.coalesce(F.col(by), F.lit("")) == ""
    value = F.when(blank, F.concat(F.lit("\0"), F.xxhash64("record").cast("string"))).otherwise(F.col(by))
    keyed = keys.select(F.col(by).alias("_value"), F.col("key").alias(name)).hint("merge")
    return rows.withColumn("_value", value).join(keyed, "_value", "left").withColumn(name, F.when(~blank, F.col(name))).drop("_value")


def link_cascade(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(record, key, matched_by) for each record: by DOI, then by exact title, then by similar title; titles are normalised."""
    records, entries = _stored(records.select("record", "doi", "title")), _stored(entries.select("key", "doi", "title", "cited", "pos"))
    found = _with_key(records, "doi", pick(entries, "doi"), "_doi_key")
    found = _with_key(found.withColumn("title", F.when(F.col("_doi_key").isNull(), F.col("title"))), "title", pick(entries, "title"), "_title_key")
    found = found.withColumn("title", F.when(F.col("_title_key").isNull(), F.col("title")))
    every = _with_key(found, "title", _most_similar(found, entries, TITLE_SIMILARITY), "_similar_key")
    key = F.coalesce("_doi_key", "_title_key", "_similar_key")
    how = F.when(F.col("_doi_key").isNotNull(), "doi").when(F.col("_title_key").isNotNull(), "title").when(F.col("_similar_key").isNotNull(), "similar title")
    return every.select("record", key.alias("key"), how.alias("matched_by"))


def mark_duplicates(rows: DataFrame, group: str = "paper_id") -> DataFrame:
    """Add duplicate_of: null for each group's keeper (citable first, then with a PMCID, then by file), else the keeper's file.

    Rows with a null group are a group as well.
    """
    keeper = F.min_by("source_file", F.struct(~F.col("citable"), F.col("pmcid").isNull(), F.col("source_file")))
    kept = rows.groupBy(F.col(group).alias("_group")).agg(keeper.alias("_keeper"))
    joined = rows.join(kept, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("duplicate_of", F.when(F.col("source_file") != F.col("_keeper"), F.col("_keeper"))).drop("_keeper", "_group")


def choose_copies(rows: DataFrame, group: str = "first") -> DataFrame:
    """(group, best): the copy with the best (citable, source rank, paragraphs, is first)."""
    rank = F.when(F.col("source") == "jats", 2).when(F.col("source") == "grobid", 1).otherwise(0)
    return rows.groupBy(group).agg(F.max_by("source_file", F.struct("citable", rank, "paragraphs", F.col("source_file").cast("string") == F.col(group).cast("string"), F.col("source_file"))).alias("best"))


def title_containment(title: Column, body: Column, common: list[str]) -> Column:
    """Share of a title's distinctive words (five letters or more, not common) in a text; 1 with fewer than two such words."""
    words = F.filter(F.array_distinct(F.split(T.normalise_title(title), " ")), lambda w: (F.length(w) >= 5) & ~w.isin(common))
    return F.when(F.size(words) < 2, F.lit(1.0)).otherwise(F.size(F.array_intersect(words, F.split(T.normalise_title(body), " "))) / F.size(words))


def library_keys(papers: DataFrame) -> DataFrame:
    """(folded, key): citable keys, folded to lower case; the last spelling wins."""
    return papers.filter("citable AND key IS NOT NULL").groupBy(F.lower("key").alias("folded")).agg(F.max_by("key", "pos").alias("key"))


def make_pairs(sentences: DataFrame, keys: DataFrame) -> DataFrame:
    """Test pairs (chunk_id, position, query, key, numbers): sentences citing one library key, the first of equal (query, key)."""
    single = sentences.filter(F.size("keys") == 1).withColumn("folded", F.lower(F.col("keys")[0])).join(keys, "folded")
    first = Window.partitionBy("text", "key").orderBy("pos", "position")
    return single.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("chunk_id", "position", F.col("text").alias("query"), "key", T.numbers(F.col("text")).alias("numbers"))


def set_equality(left: DataFrame, right: DataFrame, size: int | None = None, seed: str = "2026") -> DataFrame:
    """(left_id, right_id) where the folded key sets agree and exactly one right row has that set; right sets must not be empty.

    ``size`` draws so many of them, the smallest hashes of seed and id.
    """

    def folded(keys: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(keys, F.lower)))

    sets = right.filter(F.size("keys") > 0).groupBy(folded(F.col("keys")).alias("_set"))
    one = sets.agg(F.count("*").alias("_n"), F.min("right_id").alias("right_id")).filter("_n = 1")
    found = left.withColumn("_set", folded(F.col("keys"))).join(one, "_set").select("left_id", "right_id")
    return found if size is None else found.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("left_id").cast("string"))), "left_id").limit(size)
