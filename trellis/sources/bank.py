"""The question bank as a whole: where it is found, which part of it is loaded, what is counted when it is saved, when it is backed up."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_task
from ..operators.hierarchy import Hierarchy
from .commits import Commits
from .files import read_graph

#: Names of a graph's default files, in the order in which they are looked for.
DEFAULT_FILES = ("system_graph_data.json", "system_graph_data.pkl")


def default_graph(spark: SparkSession, folder: str) -> Hierarchy:
    """The hierarchy of the first default file in ``folder``; a pickled one is refused."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in DEFAULT_FILES:
        if files.exists(path(f"{folder.rstrip('/')}/{name}")):
            return read_graph(spark, f"{folder.rstrip('/')}/{name}")
    raise FileNotFoundError(f"{folder} has none of {', '.join(DEFAULT_FILES)}")


def some_questions(questions: DataFrame, prefix: str | None = None, confirmed_in: DataFrame | None = None) -> DataFrame:
    """Questions whose task type or id begins with ``prefix`` and, with a state (question_id, status), that it calls confirmed."""
    out = questions
    if prefix:
        out = out.where(F.col("task_type").startswith(prefix) | F.col("id").startswith(prefix))
    if confirmed_in is not None:
        out = out.join(confirmed_in.where("status = 'confirmed'").select(F.col("question_id").alias("id")), "id", "left_semi")
    return out


def counts(questions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(what, key, n): all questions, those of each category and task type, and confirmed ones of each short task type, in one pass.

    Categories and types that are null count under ''. A confirmed question that isn't in the bank counts for nothing.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    row = lambda what, key, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(what).alias("what"), key.alias("key")))
    df, confirmed = questions, F.lit(False)
    if state is not None:
        sure = state.where("status = 'confirmed'").select(F.col("question_id").alias("id"), F.lit(True).alias("_sure")).distinct()
        df, confirmed = questions.join(sure, "id", "left"), F.coalesce(F.col("_sure"), F.lit(False))
    each = F.array_compact(F.array(row("total", F.lit("")), row("category", text(F.col("category"))), row("task_type", text(F.col("task_type"))), row("confirmed", text(short_task(F.col("task_type"), F.col("id"))), confirmed)))
    return df.select(F.explode(each).alias("x")).groupBy("x.what", "x.key").agg(F.count("*").alias("n"))


def save(questions: DataFrame, into: Commits, state: DataFrame | None = None, now: Callable[[], datetime.datetime] = datetime.datetime.now) -> int:
    """Commits the bank as it now is, with its counts and the time in the commit."""
    meta = {f"{r.what}:{r.key}": r.n for r in counts(questions, state).collect()}  # as many as categories and task types
    return into.update(lambda _: questions, meta | {"last_modified": now().isoformat()})


def backup_due(backups: list[dict], confirmed: int, today: datetime.date, force: bool = False, incremental: bool = True) -> bool:
    """Whether a backup is to be made: the first of a day, one whenever the number of confirmed questions has changed, or any by force."""
    if force or not any(b["day"] == today.isoformat() for b in backups):
        return True
    return incremental and max(int(b["confirmed"]) for b in backups) != confirmed


def backup(questions: DataFrame, state: DataFrame, into: Commits, today: datetime.date | None = None, force: bool = False, incremental: bool = True) -> int | None:
    """A version of the bank, numbered in its commit by how many questions are confirmed, if one is due; None if not."""
    day = today or datetime.date.today()
    many = some_questions(questions, confirmed_in=state).count()
    due = lambda log: backup_due([c["meta"] for c in log if "confirmed" in (c["meta"] or {})], many, day, force, incremental)
    return into.update(lambda _: questions, {"confirmed": many, "day": day.isoformat()}, only_if=due)


def backup_of(backups: Commits, confirmed: int) -> DataFrame:
    """The newest backup that was made when so many questions were confirmed."""
    found = [c["version"] for c in backups.log() if (c["meta"] or {}).get("confirmed") == str(confirmed)]
    if not found:
        raise FileNotFoundError(f"no backup of {confirmed} confirmed questions")
    return backups.read(found[-1])


