"""The incremental vector table: texts by hash, only missing ones encoded, orphans dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.shipping import ship_package
from passagemill.sources.stores import StampedTable, halved


class StaleIndex(RuntimeError):
    """Chunks without a vector."""


def missing_texts(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct (text_hash, header, text) of ``chunks`` that the store lacks."""
    return chunks.select("text_hash", "header", "text").dropDuplicates(["text_hash"]).join(store.select("text_hash"), "text_hash", "left_anti")


def lacking(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """The chunks without a vector."""
    return chunks.join(store.select("text_hash"), "text_hash", "left_anti")


def hashing_encoder(dimensions: int = 64):
    """The offline default encoder: signed hashed token counts, unit length, the same on every machine."""

    def encode(headers: list[str], texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), dimensions))
        for row, (header, text) in enumerate(zip(headers, texts, strict=True)):
            for token in re.findall("[a-z0-9]+", f"{header} {text}".lower()):
                h = zlib.crc32(token.encode())
                out[row, h % dimensions] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


@dataclass(frozen=True)
class Encoder:
    """How texts become vectors. Questions and passages may be encoded in different ways.

    ``question`` and ``passage`` take (headers, texts); a question has an empty
    header and is put behind ``instruction``. Neural models plug in here.
    """

    name: str
    passage: Callable[[list[str], list[str]], np.ndarray]
    question: Callable[[list[str], list[str]], np.ndarray]
    instruction: str = ""

    @property
    def settings(self) -> str:
        """What a stored vector depends on besides its text."""
        return f"{self.name}|{self.instruction}"

    def ask(self, text: str) -> list[float]:
        return [float(x) for x in self.question([""], [self.instruction + text])[0]]


def unnormalised(encode: Callable[[list[str], list[str]], np.ndarray], header_weight: float) -> Callable[[list[str], list[str]], np.ndarray]:
    """Header and text encoded apart and added with a weight, not brought to unit length."""

    def encode_pair(headers: list[str], texts: list[str]) -> np.ndarray:
        none = [""] * len(texts)
        return encode(none, texts) + header_weight * encode(none, headers)

    return encode_pair


#: Makers of encoders by name; each process makes one once.
ENCODERS: dict[str, Callable[[], Encoder]] = {
    "hashing": lambda: Encoder("hashing", hashing_encoder(), hashing_encoder(), "query: "),
    "hashing-pair": lambda: Encoder("hashing-pair", unnormalised(hashing_encoder(), 0.5), hashing_encoder()),
}


@cache
def load_encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name}; choose from {', '.join(ENCODERS)}")
    return ENCODERS[name]()


def encode_missing(chunks: DataFrame, store: DataFrame, encoder=None) -> DataFrame:
    """(text_hash, vector) of the texts to add to the store."""
    encoder = encoder or hashing_encoder()
    ship_package(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = encoder([h or "" for h in batch.column("header").to_pylist()], [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(list(found.astype(np.float32)), pa.list_(pa.float32()))], names=["text_hash", "vector"])

    return missing_texts(chunks, store).mapInArrow(run, "text_hash string, vector array<float>")


def refreshed_store(chunks: DataFrame, store: DataFrame, encoder=None) -> DataFrame:
    """The store after an update: vectors of texts still in use, and new ones."""
    kept = store.join(chunks.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", "vector")
    return kept.unionByName(encode_missing(chunks, store, encoder))


def load_vectors(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """(pos, vector) for every chunk; raises StaleIndex if one has none."""
    if missing := lacking(chunks, store).count():
        raise StaleIndex(f"{missing} chunks have no vector; build the index again")
    return chunks.join(store, "text_hash").select("pos", "vector")


def reuse_counts(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """(embedded, reused): distinct texts that an update would encode and keep."""
    texts = chunks.select("text_hash").distinct().join(store.select("text_hash", F.lit(1).alias("_there")).distinct(), "text_hash", "left")
    return texts.agg(F.count_if(F.col("_there").isNull()).alias("embedded"), F.count("_there").alias("reused"))


def update(chunks: DataFrame, store: StampedTable, encoder: Encoder) -> tuple[int, int]:
    """(reused, embedded) distinct texts: bring a collection's vectors up to date; vectors of texts that no chunk has go.

    Texts are encoded longest first within each task, so that one that is too
    long fails early.
    """
    there = store.read()
    counts = reuse_counts(chunks, there).first()
    ordered = chunks.repartition(F.col("text_hash")).sortWithinPartitions(F.desc(F.length("text")))
    store.replace(halved(refreshed_store(ordered, there, encoder.passage)))
    return counts["reused"], counts["embedded"]
