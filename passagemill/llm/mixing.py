"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear.
Its integral gives the source's cumulative token demand; a document that lies
at cumulative token c of its source is trained at the time at which demand
reaches c. Documents are then range-sorted by that position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.ranks import running_total
from passagemill.llm.scratch import materialize
from passagemill.llm.skew import join_skewed
from passagemill.partitions import spread

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Tokens of the mix, as a share of all tokens; a source is repeated at most so many times.
TOTAL_SHARE, MAX_REPEATS = 1.5, 2.0
#: Weight schedules as (time, relative weight) knots joined by straight lines, by the source's place modulo 3: one fades, one grows from the middle on, one is steady.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)))
Schedule = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, weight, target) from one row (source, source_size) per source.

    Water filling: sources in order of size / weight meet their cap first. What
    is left of the total, per weight left, rises while capped sources are set
    aside and falls once one is set aside that could take more, so the level is
    its maximum. Windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("source_no"), F.lit(len(weights))) + 1)
    named = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("_cap", F.lit(float(max_repeats)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    earlier = Window.orderBy(F.col("_cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    filled = named.withColumns(
        {
            "_total": F.lit(float(total_share)) * F.sum("source_size").over(everything),
            "_weights": F.sum("weight").over(everything),
            "_caps_before": F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)),
            "_weights_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    )
    level = (F.col("_total") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before"))
    levelled = filled.withColumn("_level", F.max(level).over(everything))
    target = F.least(F.col("_cap"), F.col("_level") * F.col("weight"))
    return levelled.select("source", "source_no", "source_size", "weight", target.alias("target"))


def demand_time(share: Column, schedule: Schedule) -> Column:
    """The time at which a source with ``schedule`` has asked for ``share`` (0 to 1) of its tokens.

    Between knots the weight is w(x) = s + m x, whose integral is s x + m x^2 / 2.
    The segment is the one in which the cumulative demand lies; its root is
    written so that m = 0 is no special case.
    """
    times, weights = [float(t) for t, _ in schedule], [float(w) for _, w in schedule]
    if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:], strict=False)) or min(weights) < 0 or max(weights) == 0:
        raise ValueError("a schedule rises from time 0 to 1 and has weights of at least 0, not all 0")
    segments, begins = [], 0.0
    for k in range(len(times) - 1):
        segments.append((times[k], times[k + 1] - times[k], weights[k], weights[k + 1], begins))
        begins += (weights[k] + weights[k + 1]) / 2 * (times[k + 1] - times[k])
    goal, found = share * F.lit(begins), None
    for at, width, start, end, before in segments:
        inside = goal - F.lit(before)
        under = F.lit(start) + F.sqrt(F.greatest(F.lit(start * start) + inside * F.lit(2 * (end - start) / width), F.lit(0.0)))
        time = F.lit(at) + F.when(under > 0, F.least(2 * inside / under, F.lit(width))).otherwise(F.lit(0.0))
        found = time if found is None else F.when(goal >= F.lit(before), time).otherwise(found)
    return found


def _planned(rows: DataFrame, weights: Sequence[float], total_share: float, max_repeats: float, schedules: Sequence[Schedule]) -> DataFrame:
    """Add source_no, source_size, target, passes and position to written rows that have doc_id, source, size and _text."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, max_repeats)
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    targets = materialize(targets.withColumn("_named", named).drop("source"), "mixing-targets")
    joined = join_skewed(rows.withColumn("_named", named), targets, "_named").drop("_named")
    ranked = running_total(joined, ["source_no"], F.col("size"), ["doc_id", "_text", "size"], "_before")
    goal = F.round("target").cast("long")
    rounds = int(max_repeats) + (max_repeats % 1 > 0)
    kind = F.pmod(F.col("source_no"), F.lit(len(schedules)))

    def time(share: Column) -> Column:
        found = demand_time(share, schedules[-1])
        for k in range(len(schedules) - 1):
            found = F.when(kind == k, demand_time(share, schedules[k])).otherwise(found)
        return found

    def one(no: Column) -> Column:
        begins = no * F.col("source_size") + F.col("_before")
        words = F.greatest(F.least(F.col("size"), goal - begins), F.lit(0))
        return F.struct(time(begins / F.greatest(goal, F.lit(1))).alias("position"), words.cast("long").alias("words"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), one), lambda p: p["words"] > 0)
    return ranked.withColumn("passes", passes).withColumn("position", F.get("passes", F.lit(0))["position"])


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS, schedules: Sequence[Schedule] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, position, passes; sorted by the first position.

    A source's documents form a ring in a fixed pseudo-random order; the mix
    takes target words from it: whole passes, and then documents from the start
    of the ring until the target is met, the last one in part. ``passes`` lists
    (position, words); position is the training time in 0..1. Documents that
    the mix leaves out have taken 0 and come last. Null text has no words, null
    is a source of its own, sources without words have target 0, repeated rows
    are separate documents, an empty table gives an empty result. Texts of any
    length count whole. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    mixed = _planned(materialize(slim, "mixing-sizes"), weights, total_share, max_repeats, schedules)
    mixed = mixed.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source", "source_size", F.col("target").cast("double").alias("target"), "taken", "position", "passes")


def _row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that rows share only if they agree in every column (map and variant columns aside)."""
    named = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    parts = [x for c in named for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("_key"), F.xxhash64(F.lit(1), *parts).alias("_other")]


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS, schedules: Sequence[Schedule] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in training order and with the columns of ``docs``: a row for each pass that takes at least half of a document.

    Texts stay whole, so a source's words differ from its target by half a
    document at most. The plan is made without texts; they are shuffled once to
    meet it and once into the order of positions. Demand is about equal over
    training time, so that equal ranges of positions make equal partitions.
    Nulls, repeated rows and an empty table are as for ``mix_sources``.
    """
    keys = ["_key", "_other"]
    slim = docs.select(
        *_row_keys(docs), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")
    )
    slim = materialize(slim, "mixing-sizes")
    planned = _planned(slim, weights, total_share, max_repeats, schedules)
    plan = planned.select(*keys, "doc_id", F.explode(F.filter("passes", lambda p: 2 * p["words"] >= F.col("size"))).alias("_pass"))
    plan = materialize(plan.select(*keys, "doc_id", "_pass.position"), "mixing-plan")
    texts = docs.select(*_row_keys(docs), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    again = materialize(slim.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys), "mixing-repeats")
    if not again.isEmpty():
        # Rows equal in every column: one of them meets the plan of all.
        one = join_skewed(texts, again, keys, "left_semi").groupBy(*keys).agg(F.any_value("_row").alias("_row"))
        texts = join_skewed(texts, again, keys, "left_anti").unionByName(one)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.join(plan.hint("shuffle_hash"), keys).withColumn("_part", F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int"))
    return placed.repartitionById(parts, F.col("_part")).sortWithinPartitions("position", "doc_id").select("_row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
