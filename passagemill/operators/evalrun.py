"""An evaluation run: questions, every configuration on them, reranked forms, comparisons, and the report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import evaluation, linkage, ranking

DEPTHS = (20, 50)


def pair_questions(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (query_id, text, numbers) and answers (query_id, paper) of test pairs (chunk_id, position, query, key, numbers)."""
    rows = pairs.select(F.xxhash64("chunk_id", "position").alias("query_id"), F.col("query").alias("text"), "key", "numbers")
    return rows.select("query_id", "text", "numbers"), rows.select("query_id", F.col("key").alias("paper"))


def realistic_questions(questions: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and answers of (query_id, text, keys); a key that no citable paper has stops the run. ``keys`` has (key)."""
    answers = questions.select("query_id", F.explode("keys").alias("paper"))
    unknown = [r["paper"] for r in answers.join(keys.select(F.col("key").alias("paper")), "paper", "left_anti").select("paper").distinct().orderBy("paper").limit(20).collect()]
    if unknown:
        raise ValueError(f"not citable papers of the library: {', '.join(unknown)}")
    return questions.select("query_id", "text", T.numbers(F.col("text")).alias("numbers")), answers


def book_questions(entries: DataFrame, passages: DataFrame, size: int | None = 100, seed: str = "2026") -> tuple[DataFrame, DataFrame]:
    """Summaries of a paragraph index as questions, answered by the one paragraph that cites the same keys.

    entries has (query_id, summary, keys), passages (chunk_id, kind, keys).
    ``size`` of those that qualify are drawn by a fixed seed.
    """
    paragraphs = passages.filter("kind = 'paragraph'").select(F.col("chunk_id").alias("right_id"), "keys")
    found = linkage.set_equality(entries.select(F.col("query_id").alias("left_id"), "keys"), paragraphs, size, seed)
    answers = found.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("paper"))
    questions = entries.join(answers.select("query_id"), "query_id", "left_semi").select("query_id", F.col("summary").alias("text"), T.numbers(F.col("summary")).alias("numbers"))
    return questions, answers


@dataclass
class Run:
    """values (config, config_no, query_id, metric, value), places (config, query_id, place), the best fusion and each configuration's number share."""

    values: DataFrame
    places: DataFrame
    best: str
    numbers: dict[str, float | None]


def evaluate(questions: DataFrame, answers: DataFrame, rankings: dict[str, DataFrame], papers: DataFrame, chunks: DataFrame, configurations: Sequence[tuple[str, ...]], depths: Sequence[int] = DEPTHS) -> Run:
    """Every configuration, and the best fusion reranked at each depth, on the same questions.

    rankings are (query_id, pos, rank) by method, papers (pos, paper) says what
    a passage counts for, chunks has (pos, index_text, text). ``config_no``
    keeps the configurations' order; reranked forms follow.
    """
    rows = ranking.configurations(rankings, list(configurations)).select("config_no", "config", "query_id", "pos", "rank")
    values, places = _scored(rows, questions, answers, papers)
    best = evaluation.best_configuration(values).first()
    name = best["config"] if best else "+".join(configurations[0])
    fused = rows.filter(F.col("config") == name)
    deep = ranking.rerank_depths(fused, questions, chunks, tuple(depths))
    reranked = deep.select((F.lit(len(configurations)) + F.col("depth")).alias("config_no"), F.concat(F.lit(f"{name}, reranked "), "depth").alias("config"), "query_id", "pos", "rank")
    more, more_places = _scored(reranked, questions, answers, papers)
    shares, every = {}, rows.unionByName(reranked)
    texts = chunks.select("pos", "text").join(papers, "pos")
    for config in [r["config"] for r in every.select("config_no", "config").distinct().orderBy("config_no").collect()]:
        shares[config] = evaluation.number_share(every.filter(F.col("config") == config), texts, answers, questions).first()["share"]
    return Run(values.unionByName(more), places.unionByName(more_places), name, shares)


def _scored(rows: DataFrame, questions: DataFrame, answers: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    best = rows.join(papers, "pos").groupBy("config_no", "config", "query_id", "paper").agg(F.min("rank").alias("best"))
    order = F.row_number().over(_by_config())
    placed = best.select("config_no", "config", "query_id", "paper", order.alias("place"))
    found = placed.join(answers, ["query_id", "paper"], "left_semi").groupBy("config_no", "config", "query_id").agg(F.min("place").cast("long").alias("place"))
    asked = rows.select("config_no", "config").distinct().crossJoin(questions.select("query_id"))
    places = asked.join(found, ["config_no", "config", "query_id"], "left")
    return evaluation.metric_values(places), places.select("config", "query_id", "place")


def _by_config():
    from pyspark.sql import Window

    return Window.partitionBy("config_no", "config", "query_id").orderBy("best", "paper")


def summarised(run: Run) -> list[dict]:
    """Rows (config, metric, mean, low, high), configurations in their order."""
    order = {r["config"]: r["config_no"] for r in run.values.select("config", "config_no").distinct().collect()}
    rows = [r.asDict() for r in evaluation.summary(run.values.drop("config_no"), ["config", "metric"]).collect()]
    return sorted(rows, key=lambda r: (order[r["config"]], r["metric"]))


def report(run: Run, baseline: str, title: str = "Evaluation") -> tuple[str, str]:
    """The run as Markdown and as JSON: configurations with intervals, paired differences from ``baseline``, and the place of each answer."""
    from passagemill.serving.report import results_table, signed

    rows = summarised(run)
    gains = [r.asDict() for r in evaluation.paired_difference(run.values.drop("config_no"), baseline).collect()]
    lines = [f"# {title}", "", results_table(rows, run.numbers), "", f"Best fusion by reciprocal rank: {run.best}.", "", f"Differences from {baseline} on the same questions:", ""]
    for config in dict.fromkeys(r["config"] for r in rows if r["config"] != baseline):
        cells = [f"{g['metric']} {signed(g['mean'], g['low'], g['high'])}" for g in sorted(gains, key=lambda g: g["metric"]) if g["config"] == config]
        lines.append(f"- {config}: {', '.join(cells)}.")
    places = run.places.groupBy("query_id").pivot("config", list(dict.fromkeys(r["config"] for r in rows))).agg(F.first("place")).orderBy("query_id")
    told = [r.asDict() for r in places.limit(200).collect()]
    lines += ["", "| question | " + " | ".join(c for c in places.columns[1:]) + " |", "|" + "---|" * len(places.columns)]
    lines += ["| " + " | ".join("–" if v is None else str(v) for v in r.values()) + " |" for r in told]
    return "\n".join(lines) + "\n", json.dumps({"configurations": rows, "differences": gains, "best": run.best, "numbers": run.numbers}, indent=2)
