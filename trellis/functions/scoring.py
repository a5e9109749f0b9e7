"""Correctness, status and score of evaluation rows, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_SCORE = ["parse_error", "api_error", "tool_error", "no_judge", "judge_parse_error"]
SCORABLE = ["success", "parse_error", "api_error", "tool_error", "judge_parse_error"]
PASS_MARK = 3


def f1(answer: Column, gold: Column) -> Column:
    """F1 of two sets: both empty 1, one empty 0."""
    a, g = F.array_distinct(answer), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, g))
    return (
        F.when((F.size(a) == 0) & (F.size(g) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(g) == 0), 0.0)
        .otherwise(2.0 * both / (F.size(a) + F.size(g)))
    )


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def question_score(judge: Column, status: Column, kind: Column, answer: Column, gold: Column, is_correct: Column) -> Column:
    """0 to 1: a judge's score over all; nothing for an error; F1 for a list; else right or wrong."""
    return (
        F.when(judge.isNotNull(), judge / 5.0)
        .when(status.isin(NO_SCORE), 0.0)
        .when(kind == "multi", F.coalesce(f1(F.coalesce(answer, F.array().cast("array<string>")), gold), F.lit(0.0)))
        .otherwise(F.coalesce(is_correct, F.lit(False)).cast("double"))
    )


def is_correct(kind: Column, answer: Column, gold: Column) -> Column:
    """Equal sets for a list, the equal letter for a single choice; no answer is wrong."""
    return F.coalesce(
        F.when(kind == "multi", same_set(answer, gold)).otherwise((F.size(answer) == 1) & (F.try_element_at(answer, F.lit(1)) == F.try_element_at(gold, F.lit(1)))),
        F.lit(False),
    )


def status_of(errors: Column, answer: Column) -> Column:
    """api_error, tool_error, parse_error or success; ``errors`` has the types of what went wrong."""
    return F.when(F.array_contains(errors, "api_error"), "api_error").when(F.array_contains(errors, "tool_error"), "tool_error").when(answer.isNull(), "parse_error").otherwise("success")


def judge_status(has_judge: Column, errors: Column, response: Column, judged: Column) -> Column:
    """Status of a judged row; ``judged`` is the judge's own status."""
    return (
        F.when(~has_judge, "no_judge")
        .when(F.array_contains(errors, "api_error"), "api_error")
        .when(F.array_contains(errors, "tool_error") & (F.coalesce(response, F.lit("")) == ""), "tool_error")
        .when(judged.isin("success", "api_error"), judged)
        .otherwise("judge_parse_error")
    )


def panel_mean(scores: Column) -> Column:
    """Mean of a map's non-null values, null if there are none."""
    v = F.filter(F.map_values(scores), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0).cast("long"), lambda t, x: t + x) / F.size(v))


def passes(judge: Column) -> Column:
    return judge >= PASS_MARK
