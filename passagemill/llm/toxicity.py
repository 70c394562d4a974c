"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each hashed n-gram's document counts in toxic and other training texts give a
log-count ratio r; a text's features are r where the n-gram is present, and a
logistic regression on those features gives the score (Wang and Manning, 2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.scratch import materialize
from passagemill.partitions import spread
from passagemill.shipping import ship_package

#: Labelled rows that the classifier is fitted on at most, smallest hash of the id first.
TRAINING_ROWS = 20_000
#: Lengths of the n-grams, bits of their hash, and how many of the 2^18 buckets, those that tell most about the label, the regression sees; a parameter of ``fit_toxicity_model``.
LENGTHS, HASH_BITS, FEATURES = (3, 4, 5), 18, 1024
#: Training texts in which an n-gram must occur.
MIN_TEXTS = 5
THRESHOLD = 0.3
_TASKS = 8
_STEP = np.uint32(0x01000193)
_SPREAD = {3: np.uint32(0x9E3779B1), 4: np.uint32(0x85EBCA6B), 5: np.uint32(0xC2B2AE35)}


def ngram_buckets(text: str | None) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-cased text with single spaces, in no particular order."""
    folded = f" {' '.join((text or '').lower().split())} "
    c = np.frombuffer(folded.encode("utf-32-le", "replace"), dtype=np.uint32)
    found, h = [], c
    for n in range(2, max(LENGTHS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _STEP + c[n - 1 :]
        if n in LENGTHS:
            mixed = (h ^ (h >> np.uint32(15))) * _SPREAD[n]
            found.append(mixed >> np.uint32(32 - HASH_BITS))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class ToxicityModel:
    """``place``: feature number of each bucket or -1; ``weights``: ratio times coefficient of each feature."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, text: str | None) -> np.ndarray:
        found = self.place[ngram_buckets(text)]
        flags = np.zeros(len(self.weights), dtype=bool)
        flags[found[found >= 0]] = True
        return flags

    def score(self, text: str | None) -> float:
        z = self.bias + (float(self.weights[self.present(text)].sum()) if len(self.weights) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Training texts with each bucket, of label 1 and 0; one dense array per task is added up on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, texts = np.zeros((2, 1 << HASH_BITS), dtype=np.int32), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                totals[label][np.unique(ngram_buckets(text))] += 1
                texts[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array([totals.tobytes()], pa.binary()), pa.array([texts[1]], pa.int64()), pa.array([texts[0]], pa.int64())], names=["totals", "toxic", "other"])

    totals, toxic, other = np.zeros((2, 1 << HASH_BITS), dtype=np.int64), 0, 0
    for row in rows.mapInArrow(count, "totals binary, toxic long, other long").toLocalIterator():
        totals += np.frombuffer(row["totals"], dtype=np.int32).reshape(2, -1)
        toxic, other = toxic + row["toxic"], other + row["other"]
    return totals[1], totals[0], toxic, other


def choose_features(pos: np.ndarray, neg: np.ndarray, toxic: int, other: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by the G statistic of presence against label, and their log-count ratios."""
    ratio = np.log((pos + 1) / (toxic + 2)) - np.log((neg + 1) / (other + 2))
    seen, n = pos + neg, max(1, toxic + other)

    def part(k, m):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / np.maximum(m, 1e-12)), 0)

    gain = part(pos, seen * toxic / n) + part(neg, seen * other / n) + part(toxic - pos, (n - seen) * toxic / n) + part(other - neg, (n - seen) * other / n)
    gain[seen < MIN_TEXTS] = -1
    chosen = np.argsort(-gain, kind="stable")[:features]
    chosen = np.sort(chosen[gain[chosen] > 0])
    return chosen, ratio[chosen]


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Coefficients by Nesterov gradient steps on the L2-penalised log loss of the scaled presence features."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
    x = ratios[column]
    w, bias = np.zeros(len(ratios)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    row_norm = np.bincount(owner, x * x, len(rows)) + 1
    rate = 1 / (0.25 * np.mean(row_norm) + penalty / max(1, len(rows)))
    ahead, ahead_bias, momentum = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.bincount(owner, x * ahead[column], len(rows)) + ahead_bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels
        gradient = np.bincount(column, x * error[owner], len(ratios)) / len(rows) + penalty / len(rows) * ahead
        new, new_bias = ahead - rate * gradient, ahead_bias - rate * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_bias = new + (momentum - 1) / following * (new - w), new_bias + (momentum - 1) / following * (new_bias - bias)
        w, bias, momentum = new, new_bias, following
    return w, bias


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training_rows: int = TRAINING_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on at most ``training_rows`` labelled rows with ``learnable`` (an expression on the id) true.

    Null labels are left out, a repeated label counts as its maximum. Equal
    rows count as one; ids that repeat with other texts are rows of their own,
    within the same bound. Tied n-grams go by the number of their bucket.
    Without rows of both labels every text scores the share of label 1.
    """
    ship_package(docs.sparkSession)
    known = labels.filter(learnable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(training_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    # Repeated ids may give more rows than labels: the bound holds for rows, which are chosen without their texts.
    keys = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "label").distinct().orderBy(F.xxhash64("_id"), "_id", "_text").limit(training_rows)
    rows = texts.join(F.broadcast(keys), ["_id", "_text"]).repartition(_TASKS, "_id").dropDuplicates(["_id", "_text"])
    rows = materialize(rows.select("_id", "text", "label"), "toxicity-training")
    pos, neg, toxic, other = _class_counts(rows.coalesce(_TASKS))
    place = np.full(1 << HASH_BITS, -1, dtype=np.int16)
    if not toxic or not other:
        return ToxicityModel(place, np.zeros(0), float(np.log((toxic + 1) / (other + 1))))
    chosen_buckets, ratios = choose_features(pos, neg, toxic, other, min(features, (1 << 15) - 1))
    place[chosen_buckets] = np.arange(len(chosen_buckets))
    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel(place, np.zeros(len(ratios)), 0.0))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(shared.value.present(t)).astype(np.int16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array(kept, pa.binary())], names=["_id", "label", "features"])

    reduced = rows.mapInArrow(reduce, f"_id {rows.schema['_id'].dataType.simpleString()}, label int, features binary").orderBy(F.xxhash64("_id"), "_id", "features").select("label", "features").collect()
    sparse = [np.frombuffer(r["features"], dtype=np.int16) for r in reduced]
    w, bias = fit_logistic(sparse, np.array([r["label"] for r in reduced], dtype=float), ratios)
    return ToxicityModel(place, w * ratios, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus score (0 to 1) and predicted; null and empty texts score what the text-free model says.

    Texts of any length are read whole; repeated rows are rows like any others;
    an empty table gives an empty result. Columns of ``docs`` named score or
    predicted are replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
