"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over the common
words of a language are compared with the language's references by
Jensen-Shannon distance. Common words are each language's most frequent ones,
counted over all its documents; references are mean histograms over its
documents, taken twice: over all, and then over those within the limits of the
first means, so that junk does not move them. A document is judged by the
language that it is closest to, so a mislabelled or mixed text is not punished
for its label. Documents under the length guard are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm import kernels as K
from passagemill.llm.scratch import materialize
from passagemill.partitions import spread
from passagemill.shipping import ship_package

#: Common words of a language: its most frequent ones.
COMMON_WORDS = 40
#: Words under which a document is neither judged nor counted into a reference.
MIN_WORDS = 50
#: Largest distances that pass; both lie beyond what ordinary prose of any language reaches.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.60
#: Word distance that passes at most, as a share of what a text without any common word has from the reference.
MAX_WORD_SHARE = 0.90
#: Share of common words in a reference under which it cannot tell texts without them, so only MAX_WORD_DISTANCE holds.
MIN_COMMON = 0.10
#: Numbers that all references may have together; a table with more languages than that allows is refused.
MAX_REFERENCE_NUMBERS = 4_000_000
#: Words of a partition that are counted together.
_TOGETHER = 2_000_000
_SYMBOLS = b"#*$%&|<>"
_CLASSES = 8


def _class_table() -> np.ndarray:
    """256 x 8: lower, upper, digit, blank, line end, punctuation, symbol, other characters (by lead byte)."""
    kind = np.full(256, 6)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[32, 9]] = 3
    kind[[10, 11, 12, 13]] = 4
    kind[list(b".,;:!?'\"()-")] = 5
    kind[0xC0:] = 7
    table = np.eye(_CLASSES, dtype=np.int64)[kind]
    table[0x80:0xC0] = 0
    return table


def common_words(docs: DataFrame, count: int = COMMON_WORDS, min_words: int = MIN_WORDS, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Hashes of each language's most frequent words (A-Z folded), counted over all its documents of at least ``min_words`` words; ties by hash."""
    ship_package(docs.sparkSession)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in waiting.items():
                words, uses = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.view(np.int64)), pa.array(uses.astype(np.int64))], names=["lang", "word", "uses"])

        for batch in batches:
            words, limits = K.word_hashes(batch.column("text"))
            for lang, low, high in zip(batch.column("lang").to_pylist(), limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                if high - low >= min_words:
                    waiting.setdefault(lang, []).append(words[low:high])
                    held += high - low
            if held >= _TOGETHER:
                yield from out()
                waiting, held = {}, 0
        yield from out()

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count_words, "lang string, word long, uses long").groupBy("lang", "word").agg(F.sum("uses").alias("uses"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("uses"), "word"))
    found: dict[str, list[int]] = {}
    for row in counted.withColumn("place", place).filter(F.col("place") <= count).collect():
        found.setdefault(row["lang"], []).append(row["word"])
    if len(found) * (count + _CLASSES) > MAX_REFERENCE_NUMBERS:
        raise ValueError(f"{len(found)} languages need more than {MAX_REFERENCE_NUMBERS} numbers of references")
    return {lang: np.sort(np.array(words, dtype=np.int64).view(np.uint64)) for lang, words in sorted(found.items())}


def _all_words(vocabulary: dict[str, np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *vocabulary.values()]))


def repeated_words(words: np.ndarray, n: int = 3) -> int:
    """How many words lie in an n-word window that occurs twice or more."""
    grams = K.ngram_hashes(words, n)
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(grams, again)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(n):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier line."""
    if b"\n" not in text:
        return 0
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


def document_statistics(docs: DataFrame, vocabulary: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes (histogram), words and uses (common words that occur, by place among all, and how often)."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    listed = docs.sparkSession.sparkContext.broadcast(_all_words(vocabulary))
    table = _class_table()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        for batch in batches:
            text = batch.column("text")
            data, offsets = K.text_buffer(text)
            words, limits = K.word_hashes(text, lower=False)
            folded, _ = K.word_hashes(text, lower=True)
            at = np.minimum(np.searchsorted(known, folded), max(0, len(known) - 1))
            match = np.flatnonzero(known[at] == folded) if len(known) else np.zeros(0, dtype=np.int64)
            owner = np.searchsorted(limits, match, side="right") - 1
            cells, uses = np.unique(owner * max(1, len(known)) + at[match], return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(text) + 1) * max(1, len(known)))
            rows, histograms = [], np.zeros((len(text), 256), dtype=np.int64)
            for d in range(len(text)):
                part = data[offsets[d] : offsets[d + 1]]
                histograms[d] = np.bincount(part, minlength=256)
                rows.append((repeated_lines(part.tobytes()), repeated_words(words[limits[d] : limits[d + 1]])))
            classes = histograms @ table
            counts = np.diff(limits)
            word_chars = classes.sum(axis=1) - histograms[:, K.SPACE].sum(axis=1)
            again = np.array(rows, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"), pa.array(counts), pa.array(word_chars), pa.array(histograms[:, list(_SYMBOLS)].sum(axis=1)),
                    pa.array(again[:, 0]), pa.array(again[:, 1]), _lists(classes.ravel(), np.arange(len(text) + 1) * _CLASSES), _lists(cells % max(1, len(known)), ends), _lists(uses, ends),
                ],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "words", "uses"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, words array<long>, uses array<long>"
    return docs.mapInArrow(scan, schema)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64)))


def language_references(statistics: DataFrame, vocabulary: dict[str, np.ndarray], min_words: int = MIN_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean (class shares, shares of the language's common words and of all others) over all documents of a language that pass the length guard."""
    judged = statistics.filter((F.col("n_words") >= min_words) & F.col("lang").isNotNull())
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    means = judged.groupBy("lang").agg(F.count("*").alias("docs"), *(F.avg(F.col("classes")[k] / total).alias(f"s{k}") for k in range(_CLASSES)))
    known = _all_words(vocabulary)
    places = {lang: np.searchsorted(known, words) for lang, words in vocabulary.items()}
    own = statistics.sparkSession.createDataFrame([(lang, int(p)) for lang, at in places.items() for p in at], "lang string, word long")
    uses = judged.select("lang", "n_words", F.explode(F.arrays_zip("words", "uses")).alias("x")).select("lang", F.col("x.words").alias("word"), (F.col("x.uses") / F.col("n_words")).alias("share"))
    shares = {(r["lang"], r["word"]): r["share"] for r in uses.groupBy("lang", "word").agg(F.sum("share").alias("share")).join(F.broadcast(own), ["lang", "word"]).collect()}
    found = {}
    for row in sorted(means.collect(), key=lambda r: r["lang"]):
        words = np.array([shares.get((row["lang"], int(p)), 0.0) for p in places.get(row["lang"], ())]) / row["docs"]
        found[row["lang"]] = (np.array(row[2:], dtype=float), np.append(words, max(0.0, 1 - words.sum())))
    return found


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (0 to 1, logarithms to base 2) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip(terms / 2, 0, 1))


def word_limit(reference: np.ndarray, max_word: float = MAX_WORD_DISTANCE) -> float:
    """The largest word distance from ``reference`` that passes."""
    if 1 - reference[-1] < MIN_COMMON:
        return max_word
    bare = np.zeros((1, len(reference)))
    bare[0, -1] = 1
    return min(max_word, MAX_WORD_SHARE * float(jensen_shannon(bare, reference)[0]))


def judge(statistics: DataFrame, vocabulary: dict[str, np.ndarray], references: dict[str, tuple[np.ndarray, np.ndarray]], min_words: int = MIN_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Add closest_lang, class_distance, word_distance and diverges (null, null, null, false under the guard); ties go to the first language by name."""
    ship_package(statistics.sparkSession)
    known = _all_words(vocabulary)
    places = {}
    for lang in references:
        column = np.full(len(known) + 1, -1, dtype=np.int64)
        column[np.searchsorted(known, vocabulary[lang])] = np.arange(len(vocabulary[lang]))
        places[lang] = column.astype(np.int16)
    shared = statistics.sparkSession.sparkContext.broadcast((references, places))
    added = ["closest_lang", "class_distance", "word_distance", "diverges"]
    columns = [c for c in statistics.columns if c not in added]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, columns_of = shared.value
        names = list(learned)
        limits = np.array([word_limit(learned[name][1], max_word) for name in names])
        for batch in batches:
            n = batch.num_rows
            classes = batch.column("classes").flatten().to_numpy().reshape(n, -1).astype(float)
            counts = batch.column("n_words").to_numpy()
            judged = (counts >= min_words) & bool(names)
            closest, by_class, by_word = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n)
            if names:
                classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
                words, uses = batch.column("words").flatten().to_numpy(), batch.column("uses").flatten().to_numpy()
                owner = np.repeat(np.arange(n), pc.list_value_length(batch.column("words")).to_numpy())
                best = np.full(n, np.inf)
                for k, name in enumerate(names):
                    own = columns_of[name][words].astype(np.int64)
                    mine, width = own >= 0, len(learned[name][1]) - 1
                    shares = np.bincount(owner[mine] * width + own[mine], uses[mine], n * width).reshape(n, width) / np.maximum(counts, 1)[:, None]
                    shares = np.hstack([shares, np.maximum(0, 1 - shares.sum(axis=1, keepdims=True))])
                    c, w = jensen_shannon(classes, learned[name][0]), jensen_shannon(shares, learned[name][1])
                    nearer = c / max_class + w / limits[k] < best
                    best[nearer] = (c / max_class + w / limits[k])[nearer]
                    closest[nearer], by_class[nearer], by_word[nearer] = k, c[nearer], w[nearer]
            off = judged & ((by_class > max_class) | (by_word > (limits[closest] if names else max_word)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in columns), pa.array([names[k] if j else None for k, j in zip(closest, judged, strict=True)], pa.string()), pa.array(by_class, mask=~judged), pa.array(by_word, mask=~judged), pa.array(off)],
                names=[*columns, *added],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in statistics.schema if f.name in columns)
    return statistics.mapInArrow(compare, f"{schema}, closest_lang string, class_distance double, word_distance double, diverges boolean")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """One row per document: statistics, distances, base_failed and kept.

    base_failed: under 50 words, or over half of the words in 3-word windows
    that recur. kept: neither that nor a divergence beyond the limits. Null
    text is empty; a null language is part of no reference; without any
    reference nothing diverges; texts of any length are read whole; repeated
    rows and ids are rows like any others; an empty table gives an empty
    result; other columns are ignored.
    """
    vocabulary = common_words(docs, text_col=text_col, lang_col=lang_col)
    statistics = materialize(document_statistics(docs, vocabulary, id_col, text_col, lang_col), "quality-statistics")
    first = judge(statistics, vocabulary, language_references(statistics, vocabulary), **limits)
    references = language_references(first.filter(~F.col("diverges")), vocabulary)
    judged = judge(statistics, vocabulary, references, **limits).drop("classes", "words", "uses")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("diverges"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "closest_lang", "class_distance", "word_distance")
