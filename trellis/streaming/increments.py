"""Summaries that grow with what arrives: each batch adds what is new and takes back what it replaces.

Beside the partial sums lies a log of changes: of each batch the rows that became the latest of their key, each with the
row it replaced. A batch is held against the latest of the log by one grouping of both, natively: where it has a later row,
that goes out as a change of plus one, and the row it replaces as a change of minus one. A batch's changes are summed by model,
condition and task type and added to the partial sums, of which there are as many as groups; the summary is worked
out from these. Of what came before, a batch reads the log alone, and batches in any order give the summary
that all rows at once give. Sums are decimals of twelve places: what is taken back leaves nothing behind.

The order of two rows is that of (mtime, pos) and, where these are equal, of their other columns, so it doesn't depend on
when they arrive. Rows with a null in their key take no part. Nulls are less than anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.commits import Commits

ROW = "question_id string, model string, condition string, task_type string, mtime timestamp, pos long, score decimal(24,12), is_correct boolean, judge_score decimal(24,12), total_tokens long, latency_ms long"
KEY = ["question_id", "model", "condition"]
_FIELDS = ["mtime", "pos", "task_type", "score", "is_correct", "judge_score", "total_tokens", "latency_ms"]
_VALUES = "struct<" + ", ".join(f"{f}: {dict(x.split(' ', 1) for x in ROW.split(', '))[f]}" for f in _FIELDS) + ">"
#: The log: the row that became the latest of its key, the one it replaced, and in which batch.
LOG = f"question_id string, model string, condition string, new {_VALUES}, old {_VALUES}, batch long"
#: Sums of a group: rows, right ones; of each measure the sum and how many have it.
MEASURES = ["score", "judge_score", "total_tokens", "latency_ms"]
PARTIALS = "model string, condition string, task_type string, n long, correct long, known long, " + ", ".join(f"{m}_sum decimal(38,12), {m}_n long" for m in MEASURES)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed(results: DataFrame) -> DataFrame:
    """The columns of ``ROW`` of rows with a whole key."""
    plain = [F.col(f.split()[0]).cast(f.split(" ", 1)[1]) for f in ROW.split(", ")]
    return results.select(*plain).where("question_id is not null and model is not null and condition is not null")


def later(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(key, new, old): of each key the greatest of ``rows`` (of ``ROW``) if it is greater than all in ``log``, and the greatest there."""
    came = rows.select(*KEY, F.struct(*_FIELDS).alias("new"), F.lit(None).cast(_VALUES).alias("old"))
    had = log.select(*KEY, F.lit(None).cast(_VALUES).alias("new"), F.col("new").alias("old"))
    both = came.unionByName(had).groupBy(*KEY).agg(F.max("new").alias("new"), F.max("old").alias("old"))
    return both.where(F.col("new").isNotNull() & ~F.greatest("new", "old").eqNullSafe(F.col("old")))


def changes(log: DataFrame) -> DataFrame:
    """What rows of the log change: plus one for each new row, minus one for each that it replaced."""
    each = F.array_compact(F.array(F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")), F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")))))
    return log.select("model", "condition", F.explode(each).alias("x")).select("model", "condition", "x.sign", "x.row.*")


def partials_of(change: DataFrame) -> DataFrame:
    """The sums of changes, by group."""
    s = F.col("sign")
    many = lambda c: F.coalesce(F.sum(F.when(c, s).cast("long")), F.lit(0))
    each = [x for m in MEASURES for x in (F.coalesce(F.sum((F.col(m) * s).cast("decimal(26,12)")), F.lit(0)).cast("decimal(38,12)").alias(f"{m}_sum"), many(F.col(m).isNotNull()).alias(f"{m}_n"))]
    return change.groupBy("model", "condition", "task_type").agg(F.sum(s.cast("long")).alias("n"), many(F.col("is_correct")).alias("correct"), many(F.col("is_correct").isNotNull()).alias("known"), *each)


def merged(partials: DataFrame, more: DataFrame) -> DataFrame:
    """The sums of both; groups of which nothing is left go."""
    sums = [c for c in partials.columns if c not in ("model", "condition", "task_type")]
    return partials.unionByName(more).groupBy("model", "condition", "task_type").agg(*(F.sum(c).cast(partials.schema[c].dataType).alias(c) for c in sums)).where("n > 0")


def summary_of(partials: DataFrame) -> DataFrame:
    """The columns of ``summary.summary``, from partial sums."""
    mean = lambda m: F.try_divide(F.sum(f"{m}_sum").cast("double"), F.sum(f"{m}_n")).alias(f"avg_{m}")
    sets = [["model", "condition"], ["model"], ["condition"], ["task_type"], []]
    got = partials.groupingSets(sets, "model", "condition", "task_type").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("correct").cast("double"), F.sum("known")).alias("accuracy"), *(mean(m) for m in MEASURES),
        F.grouping_id("model", "condition", "task_type").cast("int").alias("grouping"),
    )
    of_task = partials.where("task_type <> ''").groupingSets([["model", "condition", "task_type"], ["model", "task_type"], ["condition", "task_type"], ["task_type"]], "model", "condition", "task_type").agg(
        F.try_divide(F.sum("score_sum").cast("double"), F.sum("score_n")).alias("_mean"), F.grouping_id("model", "condition", "task_type").cast("int").alias("_g")
    )
    macro = of_task.groupBy("model", "condition", (F.col("_g") + 1).alias("grouping")).agg(F.avg("_mean").alias("macro_score"))
    m, c, g = (got[x].eqNullSafe(macro[x]) for x in ("model", "condition", "grouping"))
    whole = got["grouping"].isin(1, 7)
    return got.join(macro, m & c & g, "left").select(
        got["model"], got["condition"], "task_type", got["grouping"], "n", "accuracy", "avg_score", F.when(got["grouping"] != 6, F.coalesce("macro_score", F.lit(0.0))).alias("macro_score"),
        F.when(whole, F.col("avg_total_tokens")).alias("avg_tokens"), F.when(whole, F.col("avg_latency_ms")).alias("avg_latency_ms"), "avg_judge_score",
    )


def keep_partials(results: DataFrame, into: Commits, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds each batch's changes to the partial sums in ``into`` (of schema ``PARTIALS``); the log of changes lies below it.

    A commit to the log names the batch, as does the one to the sums, and a batch that a commit names already is not added again:
    a rerun after a failure takes the changes that the log has of it, or finds them anew, and changes nothing twice.
    """
    log = Commits(into.spark, f"{into.path}/_changes", LOG)

    def step(batch: DataFrame, number: int) -> None:
        fresh = lambda commits: not any((c["meta"] or {}).get("batch") == str(number) for c in commits)
        if not fresh(into.log()):
            return
        if fresh(log.log()):
            log.add(later(typed(batch), log.read()).withColumn("batch", F.lit(number)), {"batch": number})
        more = changes(log.read().where(F.col("batch") == number))
        into.update(lambda partials: merged(partials, partials_of(more)), {"batch": number}, only_if=fresh)

    writer = results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_new(questions: DataFrame, into: Commits, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each question whose id has not come before; the ids are in the state store, so a batch costs what it holds.

    Questions without an id take no part. A batch that a commit names is not appended again.
    """
    columns = [f.name for f in into.schema]

    def step(batch: DataFrame, number: int) -> None:
        if not any((c["meta"] or {}).get("batch") == str(number) for c in into.log()):
            into.add(batch.select(*columns), {"batch": number})

    writer = questions.where("id is not null").dropDuplicates(["id"]).writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Sets ``PROVIDER`` for the streams that begin inside, and what was set before again after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
