"""Which files have been read: a table of path, time and size, so that the next run reads only what is new or has changed.

A file counts as read once its rows are in the target and its line is in the ledger, in this order: a run that dies in
between reads some files again, and the last writer of a key wins as before. Listing reads no contents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import last_writer_wins
from ..steps import kept
from .commits import Commits

FILES = "path string, mtime timestamp, size long"
#: Paths that are handed to a reader by name; more are found by their time.
BY_NAME = 10_000

Read = Callable[[DataFrameReader, list[str]], DataFrame]


def listing(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, mtime, size) of the files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def changed(spark: SparkSession, path: str, ledger: Commits, pattern: str = "*.json") -> DataFrame:
    """The files that the ledger lacks, or has with another time or size."""
    return listing(spark, path, pattern).join(ledger.read(), ["path", "mtime", "size"], "left_anti")


def read_files(files: DataFrame, path: str, read: Read, pattern: str = "*.json") -> DataFrame | None:
    """The rows of ``files`` with ``_path`` and ``_mtime``; None if there are none. ``read`` is given a reader and what to read.

    A few files are read by name. Of many, those since the oldest of them are read, and what is of other files is left
    out; so no list of files goes through the driver.
    """
    spark = files.sparkSession
    many = files.agg(F.count("*").alias("n"), F.min("mtime").alias("first")).first()
    if not many.n:
        return None
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    own = ["*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_mtime")]
    if many.n <= BY_NAME:
        return read(reader, [r.path for r in files.select("path").collect()]).select(*own)
    since = files.agg(F.date_format(F.min("mtime") - F.expr("interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    return read(reader.option("modifiedAfter", since).option("timeZone", spark.conf.get("spark.sql.session.timeZone")), [path]).select(*own).join(files.select(F.col("path").alias("_path")), "_path", "left_semi")


def refresh(spark: SparkSession, path: str, ledger: Commits, target: Commits, read: Read, pattern: str = "*.json") -> int:
    """Adds the rows of new and changed files to ``target`` (the columns of ``read`` with _path and _mtime); how many files these were."""
    files = kept(changed(spark, path, ledger, pattern))
    rows = read_files(files, path, read, pattern)
    if rows is None:
        return 0
    target.add(rows)
    ledger.add(files)
    return files.count()


def merged(target: Commits, keys: list[str]) -> DataFrame:
    """One row for each key: of the file written last, of equal times the one whose path comes last."""
    return last_writer_wins(target.read(), keys, "_mtime", "_path")


def open_ledger(spark: SparkSession, path: str) -> Commits:
    return Commits(spark, path, FILES, ["path"])
