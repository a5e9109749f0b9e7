"""Aggregates over evaluation results: micro and macro scores, summaries, tool benefit, facets, list views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import SCORABLE, panel_mean


def macro(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, macro_score): the mean over task types of their mean scores; rows without a task type take no part."""
    typed = results.where(F.coalesce("task_type", F.lit("")) != "")
    by_task = typed.groupBy(*keys, "task_type").agg(F.avg("score").alias("_mean"))
    return by_task.groupBy(*keys).agg(F.avg("_mean").alias("macro_score"))


def _measures() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
        F.avg("score").alias("avg_score"),
        F.avg("judge_score").alias("avg_judge_score"),
        F.avg("total_tokens").alias("avg_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    ]


def summary(results: DataFrame, *more: Column) -> DataFrame:
    """One row for each (model, condition), model, condition, task type, and for all, in one pass over grouping sets; with macro scores.

    Tokens and latency are those of (model, condition) and of all; task types have no macro score. ``more`` are further
    aggregates, named by their aliases.
    """
    sets = results.groupingSets([["model", "condition"], ["model"], ["condition"], ["task_type"], []], "model", "condition", "task_type").agg(
        *_measures(), F.grouping_id("model", "condition", "task_type").cast("int").alias("grouping"), *more
    )
    known = {"model", "condition", "task_type", "grouping", "n", "accuracy", "avg_score", "avg_judge_score", "avg_tokens", "avg_latency_ms"}
    # grouping ids: a set bit is a column that is summed over
    typed = results.where(F.coalesce("task_type", F.lit("")) != "")
    means = typed.groupingSets([["model", "condition", "task_type"], ["model", "task_type"], ["condition", "task_type"], ["task_type"]], "model", "condition", "task_type").agg(
        F.avg("score").alias("_mean"), F.grouping_id("model", "condition", "task_type").cast("int").alias("_g")
    )
    of = means.groupBy("model", "condition", (F.col("_g") + 1).alias("grouping")).agg(F.avg("_mean").alias("macro_score"))
    m, c, g = (sets[x].eqNullSafe(of[x]) for x in ("model", "condition", "grouping"))
    return sets.join(of, m & c & g, "left").select(
        sets["model"], sets["condition"], "task_type", sets["grouping"], "n", "accuracy", "avg_score",
        F.when(sets["grouping"] != 6, F.coalesce("macro_score", F.lit(0.0))).alias("macro_score"),
        F.when(sets["grouping"].isin(1, 7), F.col("avg_tokens")).alias("avg_tokens"),
        F.when(sets["grouping"].isin(1, 7), F.col("avg_latency_ms")).alias("avg_latency_ms"), "avg_judge_score", *(c for c in sets.columns if c not in known),
    )


def of_cache(documents: DataFrame) -> DataFrame:
    """``summary`` of cache documents (question_id, model, condition, task_type, is_correct, score, judge_scores, total_tokens, latency_ms).

    A document's judge score is the mean of its judges who gave one. Its score is that over 5, else the score it has, else
    whether it is right. A missing model or condition is ``unknown``, missing tokens and latency are 0; a document without a
    task type takes no part in macro scores. With n_judged, the documents that a judge scored.
    """
    judged = panel_mean(F.col("judge_scores"))
    rows = documents.withColumns({"judge_score": judged, "score": F.coalesce(judged / 5, F.col("score"), F.coalesce("is_correct", F.lit(False)).cast("double")), "is_correct": F.coalesce("is_correct", F.lit(False))})
    rows = rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("model", "condition")} | {c: F.coalesce(c, F.lit(0)) for c in ("total_tokens", "latency_ms")})
    rows = rows.withColumn("task_type", F.coalesce("task_type", F.lit("")))
    return summary(rows, F.count("judge_score").alias("n_judged")).where("grouping <> 6 or task_type <> ''")


def leaderboard(results: DataFrame) -> DataFrame:
    """(model, no_tool, tool, delta): macro scores by condition and what tools change."""
    wide = macro(results, "model", "condition").groupBy("model").pivot("condition", ["no_tool", "tool"]).agg(F.first("macro_score"))
    return wide.withColumn("delta", F.col("tool") - F.col("no_tool"))


def tool_benefit(results: DataFrame) -> DataFrame:
    """(task_type, n_models, mean_delta, sd_delta): paired over models, the difference of mean scores with and without tools."""
    means = results.groupBy("task_type", "model").pivot("condition", ["no_tool", "tool"]).agg(F.avg("score"))
    return means.withColumn("d", F.col("tool") - F.col("no_tool")).groupBy("task_type").agg(F.count("d").alias("n_models"), F.avg("d").alias("mean_delta"), F.stddev("d").alias("sd_delta"))


def filtered(results: DataFrame, model: str | None = None, condition: str | None = None, task_type: str | None = None, status: str | None = None, id_part: str | None = None) -> DataFrame:
    """Rows that match all that is given: equal model and condition, a part of the task type, a status, a part of the id in any case.

    Status ``correct`` and ``wrong`` are of correctness, wrong among the successful; others name a status.
    """
    out = results
    if model:
        out = out.where(F.col("model") == model)
    if condition:
        out = out.where(F.col("condition") == condition)
    if task_type:
        out = out.where(F.col("task_type").contains(task_type))
    if id_part:
        out = out.where(F.lower("question_id").contains(id_part.lower()))
    if status == "correct":
        out = out.where(F.col("is_correct"))
    elif status == "wrong":
        out = out.where(~F.col("is_correct") & (F.col("status") == "success"))
    elif status:
        out = out.where(F.col("status") == status)
    return out


def quick_stats(results: DataFrame) -> DataFrame:
    """(total, correct, accuracy, macro_score, n_unscored) of the rows that can be scored; rounded to 4 places."""
    can = results.where(F.col("status").isin(SCORABLE))
    base = results.agg(F.count("*").alias("total"), F.count_if(F.col("is_correct")).alias("correct"), F.count_if(~F.col("status").isin(SCORABLE)).alias("n_unscored"))
    return base.crossJoin(can.agg(F.round(F.avg("score"), 4).alias("avg_score"))).crossJoin(macro(can.withColumn("_all", F.lit(1)), "_all").select(F.round("macro_score", 4).alias("macro_score")))  # one row each


def facets(results: DataFrame) -> DataFrame:
    return results.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("model", "condition", "task_type")))


def panel(judged: DataFrame) -> DataFrame:
    """(question_id, mean_score, normalised, n_judges): of the judges who gave a score; normalised to 1, 0 if none did."""
    e = judged.select("question_id", F.explode_outer("scores").alias("judge", "score"))
    return e.groupBy("question_id").agg(F.avg("score").alias("mean_score"), (F.coalesce(F.avg("score"), F.lit(0.0)) / 5).alias("normalised"), F.count("score").alias("n_judges"))


def progress(results: DataFrame) -> DataFrame:
    return results.groupBy("model", "condition").agg(F.count_distinct("question_id").alias("done"))


def cost_estimate(matrix: DataFrame, prices: DataFrame, tokens_in: int, tokens_out: int) -> DataFrame:
    """(model, n, cost): evaluations of each model times its price per million tokens; ``prices`` is (model, price_in, price_out)."""
    return matrix.groupBy("model").agg(F.count("*").alias("n")).join(prices, "model").select(
        "model", "n", (F.col("n") * (F.col("price_in") * tokens_in + F.col("price_out") * tokens_out) / 1e6).alias("cost")
    )
