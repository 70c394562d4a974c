"""Repeated lines, found with two Bloom filters: one of hashes seen once, one of hashes seen twice.

The hashes of all lines, eight bytes each, are dealt out by range. Each range
fills both filters: a hash that meets all its bits in the first enters the
second. A hash outside the second filter belongs to a line that occurs once.
The number of ranges grows with the lines, so a filter keeps its size and its
share of false positives at any size of the corpus. Only the lines of the other
hashes, the suspects, are shuffled, compared by their full keys, and counted,
so a false positive costs a little traffic and no wrong answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.scratch import materialize
from passagemill.llm.skew import join_skewed
from passagemill.partitions import spread
from passagemill.shipping import ship_package

#: Bits of each filter at most: 2 MB.
MAX_BITS = 1 << 24
#: Bits per line aimed at, and hash functions.
BITS_PER_LINE, HASHES = 12, 3
#: Ranges of hashes, at least.
MIN_RANGES = 32
#: Suspected hashes, 8 bytes each, that are sent to all tasks; more are joined by a shuffle.
BROADCAST_SUSPECTS = 2_000_000
#: Repeated keys, a 16-byte digest and an id each, that are sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Hashes of a partition that are dealt out together.
_TOGETHER = 1 << 20
_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(_WHITE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _hashes(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], dtype=np.uint64)


class Bloom:
    """A Bloom filter over 64-bit hashes."""

    def __init__(self, bits: int):
        self.bits, self.words = np.uint64(bits), np.zeros(-(-bits // 8), dtype=np.uint8)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        at = np.stack([(h + np.uint64(k) * step) % self.bits for k in range(HASHES)], axis=1)
        return (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        byte, bit = self._places(h)
        np.bitwise_or.at(self.words, byte.ravel(), bit.ravel())

    def holds(self, h: np.ndarray) -> np.ndarray:
        byte, bit = self._places(h)
        return ((self.words[byte] & bit) != 0).all(axis=1)


def suspected(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """The distinct hashes that two parts, or one part twice, may hold."""
    once, twice = Bloom(bits), Bloom(bits)
    for part in parts:
        values, counts = np.unique(part, return_counts=True)
        twice.add(values[(counts > 1) | once.holds(values)])
        once.add(values)
    found = [part[twice.holds(part)] for part in parts]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _keys(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """(line number, key) of the lines whose key is long enough."""
    found = []
    for n, line in enumerate((text or "").split("\n")):
        # White space at the ends only shortens a line: most short lines need no key.
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
            found.append((n, key))
    return found


def _suspects(docs: DataFrame, min_chars: int, max_bits: int) -> DataFrame:
    """(hash): 64-bit hashes of line keys that may occur in two rows, each once."""
    # No text has more keys than its bytes allow.
    most = docs.agg(F.coalesce(F.sum(F.floor((F.octet_length("text") + 1) / F.lit(min_chars + 1))), F.lit(0))).first()[0]
    ranges = max(MIN_RANGES, -(-most * BITS_PER_LINE // max_bits))
    bits = min(max_bits, max(1 << 10, most * BITS_PER_LINE // ranges))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0

        def out() -> pa.RecordBatch:
            h = np.concatenate(waiting) if waiting else np.zeros(0, dtype=np.uint64)
            place = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(place, kind="stable")
            h, place = h[order], place[order]
            names, starts = np.unique(place, return_index=True)
            blobs = [x.tobytes() for x in np.split(h, starts[1:])] if len(h) else []
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], names=["range", "hashes"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = _hashes(list({key for _, key in _keys(text, min_chars)}))
                waiting.append(own)
                count += len(own)
            if count >= _TOGETHER:
                yield out()
                waiting, count = [], 0
        yield out()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by range; the hashes of one range are held, as many as the filters are made for.
        current, parts = None, []
        for batch in batches:
            for name, blob in zip(batch.column("range").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if name != current:
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array(suspected(parts, bits).view(np.int64))], names=["hash"])
                    current, parts = name, []
                parts.append(np.frombuffer(blob, dtype=np.uint64))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(suspected(parts, bits).view(np.int64))], names=["hash"])

    dealt = docs.select("text").mapInArrow(deal, "range long, hashes binary")
    return materialize(dealt.repartition("range").sortWithinPartitions("range").mapInArrow(find, "hash long"), "lines-suspected")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, broadcast_keys: int = BROADCAST_KEYS, broadcast_suspects: int = BROADCAST_SUSPECTS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A line's key (``line_key``) of at least ``min_chars`` code points found in
    at least ``min_docs`` rows loses all its lines except in the row with the
    largest id holding it (in all such rows if the id repeats; a null id is
    smallest). Rows that repeat an id count one by one. Null text is one empty
    line. A text of dropped lines only comes back empty. Texts of any length
    are read whole; an empty table gives an empty result. Other columns are
    ignored.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    suspects = _suspects(source, min_chars, max_bits)
    id_type = source.schema["doc_id"].dataType.simpleString()
    few = suspects.count() <= broadcast_suspects
    wanted = np.sort(suspects.toArrow()["hash"].to_numpy().view(np.uint64)) if few else None
    shared = source.sparkSession.sparkContext.broadcast(wanted)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, keys = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                own = list({key for _, key in _keys(text, min_chars)})
                rows += [n] * len(own)
                keys += own
            h = _hashes(keys)
            if known is not None:
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else np.zeros(0, dtype=np.int64)
                rows, keys, h = [rows[k] for k in hit], [keys[k] for k in hit], h[hit]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.string()), pa.array(h.view(np.int64))], names=["doc_id", "key", "hash"])

    found = source.mapInArrow(keyed, f"doc_id {id_type}, key string, hash long")
    if not few:
        found = join_skewed(found, suspects, "hash", "left_semi")
    # A row counts once for a key; the map side adds up before anything is shuffled.
    counted = found.groupBy("key").agg(F.count("*").alias("rows"), F.max("doc_id").alias("last"))
    repeated = materialize(counted.filter(F.col("rows") >= min_docs).select("key", F.unhex(F.md5("key")).alias("digest"), "last"), "lines-repeated")
    if repeated.count() <= broadcast_keys:
        return _drop_by_set(source, repeated, min_chars)
    return _drop_by_join(source, repeated, min_chars)


_RESULT = ["doc_id", "n_lines", "n_dropped", "text"]


def _drop_by_set(source: DataFrame, repeated: DataFrame, min_chars: int) -> DataFrame:
    """Each task drops lines by a set of digests that all tasks hold: no text is shuffled."""
    table = repeated.select("digest", "last").toArrow()
    held = source.sparkSession.sparkContext.broadcast(dict(zip(table["digest"].to_pylist(), table["last"].to_pylist(), strict=True)))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, absent = held.value, object()
        for batch in batches:
            counts, dropped, texts = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                gone = set()
                for n, key in _keys(text, min_chars):
                    keeper = last.get(hashlib.md5(key.encode("utf-8", "surrogatepass")).digest(), absent)
                    if keeper is not absent and keeper != doc_id:
                        gone.add(n)
                counts.append(text.count("\n") + 1)
                dropped.append(len(gone))
                texts.append("\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=_RESULT)

    return source.mapInArrow(drop, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string")


def _drop_by_join(source: DataFrame, repeated: DataFrame, min_chars: int) -> DataFrame:
    """For any number of repeated keys: lines of long keys meet them in a join, and the numbers of the dropped lines go back to their rows."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            keyed = [[{"line": n, "key": key} for n, key in _keys(text, min_chars)] for text in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + len(keyed)), pa.int64()), batch.column("doc_id"), batch.column("text"), pa.array(keyed, kind)], names=["uid", "doc_id", "text", "keyed"])
            uid += len(keyed)

    numbered = source.mapInArrow(number, f"uid long, doc_id {source.schema['doc_id'].dataType.simpleString()}, text string, keyed array<struct<line:int,key:string>>")
    numbered = materialize(numbered, "lines-numbered")
    lines = numbered.select("uid", "doc_id", F.explode("keyed").alias("s")).select("uid", "doc_id", "s.line", "s.key")
    gone = join_skewed(lines, repeated.select("key", "last"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("uid").agg(F.collect_list("line").alias("gone"))

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(line for n, line in enumerate((t or "").split("\n")) if n not in g) for t, g in zip(text, (set(x) for x in gone), strict=True)], dtype=object)

    rows = numbered.drop("keyed").join(gone, "uid", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines_of = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).cast("long")
    return rows.select("doc_id", lines_of.alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), without("text", "gone").alias("text"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, coalesce(k.doc_id <> r.last, false) AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
