"""Results and questions that arrive over time: rebuilt summaries, appends without repeats, folded response streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import replay, summary
from ..operators.ordering import last_writer_wins
from ..sources.snapshots import Snapshots


def read_new_files(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def keep_summary(results: DataFrame, into: Snapshots, checkpoint: str, merged: Snapshots, every: str | None = None) -> StreamingQuery:
    """For each batch of result rows: merges them into ``merged`` (the last writer of a key wins) and rebuilds the summary.

    A batch that is run again after a failure merges to the same rows.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        whole = merged.read().unionByName(batch, allowMissingColumns=True) if merged.versions() else batch
        merged.write(last_writer_wins(whole, ["question_id", "model", "condition"], "mtime", "pos"))
        into.write(summary.summary(merged.read()))

    return _started(results, step, checkpoint, every)


def append_once(questions: DataFrame, bank: Snapshots, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds questions whose id is not in the bank; repeats in a batch and over batches are dropped."""

    def step(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["id"])
        if bank.versions():
            new = new.join(bank.read().select("id"), "id", "left_anti")
            if new.isEmpty():
                return
            new = bank.read().unionByName(new)
        if not new.isEmpty():
            bank.write(new)

    return _started(questions, step, checkpoint, every)


def fold_responses(lines: DataFrame, into: Snapshots, lines_so_far: Snapshots, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Server-sent lines (response_id, seq, line) put together as they arrive."""

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        whole = lines_so_far.read().unionByName(batch) if lines_so_far.versions() else batch
        lines_so_far.write(whole.dropDuplicates(["response_id", "seq"]))
        into.write(replay.assembled(lines_so_far.read()))

    return _started(lines, step, checkpoint, every)


def _started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
