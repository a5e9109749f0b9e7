"""Which results a judge still has to see, and what becomes of its scores; categories and samples of descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_judge(results: DataFrame, questions: DataFrame, judge: str) -> DataFrame:
    """``results`` (question_id, judge_scores, status, response) with action: skipped, no_question or judge.

    Skipped is what this judge has seen (a null score counts), what has no question, and empty responses.
    """
    known = questions.select(F.col("id").alias("question_id"), F.lit(True).alias("_known")).distinct()
    seen = F.coalesce(F.map_contains_key("judge_scores", judge), F.lit(False)) | (F.coalesce("status", F.lit("")) == "no_question")
    empty = F.regexp_replace(F.coalesce("response", F.lit("")), r"\s+", "") == ""
    action = F.when(seen | empty, "skipped").when(F.col("_known").isNull(), "no_question").otherwise("judge")
    return results.join(known, "question_id", "left").withColumn("action", action).drop("_known")


def with_score(results: DataFrame, scores: DataFrame, judge: str) -> DataFrame:
    """``results`` with a judge's scores (question_id, score, null for a failure) put into their maps."""
    s = scores.select("question_id", F.col("score").alias("_s"), F.lit(True).alias("_new"))
    joined = results.join(s, "question_id", "left")
    old = F.map_filter(F.coalesce("judge_scores", F.create_map().cast("map<string,int>")), lambda k, v: k != judge)
    return joined.withColumn("judge_scores", F.when(F.col("_new"), F.map_concat(old, F.create_map(F.lit(judge), F.col("_s")))).otherwise(F.col("judge_scores"))).drop("_s", "_new")


def category_of(names: DataFrame, categories: DataFrame) -> DataFrame:
    """``names`` (name) with category: the first, by order, that lists the name in any case, else unknown."""
    first = categories.groupBy(F.lower("descriptor").alias("_k")).agg(F.min_by("category", F.struct("ord", "category")).alias("category"))
    return names.join(first, F.lower("name") == F.col("_k"), "left").withColumn("category", F.coalesce("category", F.lit("unknown"))).drop("_k")


def all_descriptors(categories: DataFrame) -> DataFrame:
    return categories.select("descriptor").distinct().orderBy("descriptor")


def sample(candidates: DataFrame, n: int, seed: str, excluded: list[DataFrame] | None = None, used: DataFrame | None = None, most_used: int = 3) -> DataFrame:
    """``n`` names by hash, of those that no table in ``excluded`` has and ``used`` has under ``most_used`` times."""
    out = candidates.select("name").distinct()
    for e in excluded or []:
        out = out.join(e.select("name"), "name", "left_anti")
    if used is not None:
        out = out.join(used.groupBy("name").count().where(F.col("count") >= most_used).select("name"), "name", "left_anti")
    return out.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "name")), "name").limit(n)


def resumed(matrix: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What of a matrix is not in a cache."""
    return matrix.join(cache.select(*keys).distinct(), keys, "left_anti")


def merged_map(base: Column, update: Column) -> Column:
    """Two maps as one; the second's values win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
