"""Review of a question bank: joins with the audit state, its changes and checks, the queue, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ["pending", "confirmed", "flagged"]


def with_status(questions: DataFrame, state: DataFrame) -> DataFrame:
    """``questions`` with the status of their review; what was never reviewed is pending."""
    s = state.select(F.col("question_id").alias("id"), "status")
    return questions.join(s, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def confirmed(questions: DataFrame, state: DataFrame) -> DataFrame:
    return questions.join(state.where("status = 'confirmed'").select(F.col("question_id").alias("id")), "id", "left_semi")


def added(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and the rows of ``new`` whose id is not there."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def orphans(state: DataFrame, questions: DataFrame) -> DataFrame:
    return state.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_anti")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` with the rows of ``changes`` in place of those of the same question: confirm, flag, unflag."""
    return state.join(changes.select("question_id"), "question_id", "left_anti").unionByName(changes, allowMissingColumns=True)


def queue_stats(questions: DataFrame, state: DataFrame) -> DataFrame:
    """(task_type, pending, confirmed, flagged, total)."""
    wide = with_status(questions, state).groupBy("task_type").pivot("status", STATES).count().fillna(0, STATES)
    return wide.withColumn("total", F.col("pending") + F.col("confirmed") + F.col("flagged"))


def filter_queue(questions: DataFrame, state: DataFrame, task_types: list[str] | None = None, statuses: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    out = with_status(questions, state)
    if task_types:
        out = out.where(F.col("task_type").isin(task_types))
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    if exclude:
        out = out.where(~F.col("status").isin(exclude))
    return out


def audit_stats(questions: DataFrame, state: DataFrame) -> DataFrame:
    """(total, confirmed, flagged, pending, progress): progress in whole percent of confirmed questions."""
    s = with_status(questions, state).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == x).alias(x) for x in STATES))
    return s.withColumn("progress", F.when(F.col("total") > 0, (F.col("confirmed") * 100 / F.col("total")).cast("int")).otherwise(0))


def violations(state: DataFrame) -> DataFrame:
    """(question_id, problem): entries that break a rule: an unknown status, no time, a flag without a reason, more than one entry."""
    rules: list[tuple[Column, str]] = [
        (~F.coalesce("status", F.lit("")).isin(STATES), "unknown status"),
        (F.col("ts").isNull(), "no timestamp"),
        ((F.col("status") == "flagged") & (F.coalesce("flag_reason", F.lit("")) == ""), "flag without reason"),
    ]
    found = state.select("question_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))).alias("problem"))
    twice = state.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("several entries").alias("problem"))
    return found.unionByName(twice)


def merge_stats(states: DataFrame) -> DataFrame:
    """(entries, total, conflicts): of state files put together; every entry of an id beyond its first is a conflict."""
    return states.agg(F.count("*").alias("entries"), F.count_distinct("question_id").alias("total")).withColumn("conflicts", F.col("entries") - F.col("total"))


def duplicate_questions(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(id, duplicate_of): questions of the same text (case and outer blanks aside) and set of options as a known one, the first by position."""
    key = lambda q: q.withColumn("_t", F.lower(F.trim("text"))).withColumn("_o", F.array_join(F.array_sort(F.array_distinct(F.map_values("options"))), "\x1f"))
    first = key(known).groupBy("_t", "_o").agg(F.min_by("id", "pos").alias("duplicate_of"))
    return key(questions).join(first, ["_t", "_o"]).where("id <> duplicate_of").select("id", "duplicate_of")


def duplicate_descriptors(questions: DataFrame) -> DataFrame:
    """(task_type, descriptor, n, ids): descriptors that several questions of a type use."""
    return questions.groupBy("task_type", "descriptor").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")


def next_to_review(questions: DataFrame, state: DataFrame, skipped: DataFrame) -> DataFrame:
    """The first pending question that was not skipped, or the first pending one if all were."""
    pending = with_status(questions, state).where("status = 'pending'").join(skipped.select("id", F.lit(1).alias("_s")), "id", "left")
    return pending.orderBy(F.coalesce("_s", F.lit(0)), "pos").limit(1).drop("_s")


def preview(questions: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The first ``n`` questions to review, pending or flagged, with texts cut at 100 characters."""
    from ..functions.text import truncated

    top = with_status(questions, state).where("status <> 'confirmed'").orderBy("pos").limit(n)
    return top.select(F.row_number().over(Window.orderBy("pos")).alias("place"), "id", "task_type", "status", truncated(F.col("text")).alias("text"))


def backups_to_delete(backups: DataFrame, keep: int = 20) -> DataFrame:
    """Of (file, name, mtime) those beyond the newest ``keep`` of each file."""
    return backups.withColumn("_rn", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("mtime"), F.desc("name")))).where(F.col("_rn") > keep).drop("_rn")


def latest_version(backups: DataFrame) -> DataFrame:
    """(version): the highest number in the names; names without one are passed over."""
    return backups.agg(F.max(F.try_to_number(F.regexp_extract("name", r"_v(\d+)", 1), F.lit("999999999"))).cast("long").alias("version"))
