"""Language identification by compression against per-language zstandard dictionaries.

A text is lower-cased and cut into blocks, each block is compressed once with every language's
raw-content dictionary, and the language with the fewest bytes wins. The
relative lead over the runner-up is the margin; narrow margins are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.partitions import spread
from passagemill.shipping import ship_package

#: Rows per language that a dictionary is made from at most, smallest hash of id and text first, and bytes of text that they may have together; one row is taken whatever its size. Texts of more bytes than that come last.
SAMPLE_ROWS, SAMPLE_BYTES = 200, 192 << 10
#: Bytes that all dictionaries may have together; a table with more is refused.
MAX_TOTAL_BYTES = 256 << 20
#: Bytes of text per compression call: short enough for the dictionary, not the text's own past, to decide.
BLOCK_BYTES = 2048
#: Lead of the winner, as a share of the runner-up's bytes, below which a text is rejected.
MIN_MARGIN = 0.002
#: Compression level and shortest match; matches of 3 bytes pick up syllables, which level 1 does not.
_LEVEL, _MIN_MATCH = 6, 3
_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def _compressors(contents: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    made = {}
    for name in sorted(contents):
        parameters = zstandard.ZstdCompressionParameters.from_level(_LEVEL, source_size=BLOCK_BYTES, dict_size=len(contents[name]), min_match=_MIN_MATCH, write_content_size=False, write_checksum=False)
        dictionary = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        made[name] = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)
    return made


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode category L; number signs such as a half are word characters but no letters."""
    return any(m.group().isalpha() for m in _WORD_CHARACTER.finditer(text))


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _sizes(data: bytes, compressors: dict[str, zstandard.ZstdCompressor]) -> dict[str, int]:
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return {name: sum(len(c.compress(b)) for b in blocks) for name, c in compressors.items()}


@dataclass
class LanguageModel:
    """Raw dictionary content by language; compressors are made on first use in each process."""

    contents: dict[str, bytes]
    min_margin: float = MIN_MARGIN
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"contents": self.contents, "min_margin": self.min_margin, "_made": {}}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). No text, no letter or no learned language: ("und", 0, 0)."""
        if not text or not self.contents or not has_letter(text):
            return "und", 0.0, 0.0
        if not self._made:
            self._made.update(_compressors(self.contents))
        ranked = sorted(_sizes(_folded(text), self._made).items(), key=lambda x: (x[1], x[0]))
        if len(ranked) == 1:
            return ranked[0][0], 1.0, 1.0
        margin = (ranked[1][1] - ranked[0][1]) / ranked[1][1]
        return ranked[0][0], min(1.0, 0.5 + 5 * margin), margin


def _fill(lines: list[str]) -> bytes:
    return _folded("\n".join(lines))


def build_model(rows: list[tuple[str, str]], min_margin: float = MIN_MARGIN) -> LanguageModel:
    """From (language, text) rows, all of whose text goes into the dictionaries. A second pass drops lines that read as another language."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    first = {lang: _fill(group) for lang, group in texts.items()}
    if (total := sum(map(len, first.values()))) > MAX_TOTAL_BYTES:
        raise ValueError(f"{len(first)} languages need {total} bytes of dictionaries, more than {MAX_TOTAL_BYTES}")
    if len(first) < 2:
        return LanguageModel(first, min_margin)
    compressors = _compressors(first)
    pure = {}
    for lang, group in texts.items():
        lines = [line for text in group for line in text.split("\n") if len(line) >= 40]
        own = [line for line in lines if min((size, name) for name, size in _sizes(_folded(line), compressors).items())[1] == lang]
        pure[lang] = _fill(own) if len(own) * 4 >= len(lines) and own else first[lang]
    return LanguageModel(pure, min_margin)


def fit_language_model(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, min_margin: float = MIN_MARGIN) -> LanguageModel:
    """Learn every language of the rows with ``learnable`` true and text and language not null, each from a bounded sample of whole texts.

    Equal rows (same id, text and language) count as one. Ids that repeat with
    other texts are rows of their own.
    """
    known = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("hash"))
    sized = known.select("lang", "hash", F.octet_length("text").alias("bytes")).withColumn("large", F.col("bytes") > sample_bytes)
    order = Window.partitionBy("lang").orderBy("large", "hash")
    # The rank is cut in each partition before anything is shuffled.
    least = sized.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= sample_rows).drop("rank").distinct()
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    chosen = least.withColumn("total", before).withColumn("place", F.row_number().over(order)).filter((F.col("place") == 1) | (F.col("total") <= sample_bytes)).select("lang", "hash")
    taken = known.join(F.broadcast(chosen), ["lang", "hash"]).dropDuplicates(["lang", "hash"]).collect()
    return build_model([(r["lang"], r["text"]) for r in sorted(taken, key=lambda r: (r["lang"], r["hash"], r["text"]))], min_margin)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus lang_pred, score, margin and rejected.

    Null text, and text without a letter, is "und" with score 0 and rejected.
    A text whose margin is below the model's is rejected but still named.
    Equal sizes go to the first language by name. Texts of any length are read
    whole; repeated rows are rows like any others; an empty table gives an empty
    result. Columns of ``docs`` with the added names are replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(text_col).to_pylist()]
            added = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.float64()),
                pa.array([f[0] == "und" or f[2] < m.min_margin for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "lang_pred", "score", "margin", "rejected"])

    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return docs.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit_language_model(docs, ~F.coalesce(held_out(), F.lit(True)))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
