"""What several operators share: tables in the shared folder, text defaults, bounded samples of labels."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, where there is one machine, may go without it and gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark, "_trellis_shared", None)
    if made is None:
        made = spark._trellis_shared = tempfile.mkdtemp(prefix="trellis-")
    return made


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: a cut of the lineage that outlives executors.

    ``by`` is a column whose values get a folder each. The table goes when the application ends, or by ``dropped``.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/trellis-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(f"{top}/{name}")
    files, at = _file_system(spark, top)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(f"{top}/{name}")
    back._trellis_top = top
    return back


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``written`` made and that nothing reads any more."""
    files, at = _file_system(table.sparkSession, table._trellis_top)
    files.delete(at, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of what is written and no longer referred to; it acts on what the collectors find."""
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors first, once for a Spark context."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """One fifth of the ids, by checksum; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label): at most ``bound`` labelled documents outside the held-out fifth.

    The sample is that of the smallest hashes of doc_id, the same on every run. Its size bound is what
    makes the broadcast of its ids safe: ``bound`` rows of two numbers. An id with several labels counts with
    the largest of them, one with several texts with the first of them in order; ids without a label or a document
    take no part.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = documents.select(F.col("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
