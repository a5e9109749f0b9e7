"""Tables between the rounds of a loop, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The path of a new folder below ``spark.checkpoint.dir``, which driver and executors share; what is put there goes when the application ends.

    Only a local master may go without that setting and gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/trellis-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a shared ``folder``, read back: a cut of the lineage that outlives executors."""
    path = folder(df.sparkSession)
    df.write.parquet(f"{path}/rows")
    back = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    back._trellis_at = path
    return back


def replaced(df: DataFrame, *former: DataFrame) -> DataFrame:
    """``kept``, after which the tables in ``former`` go: a loop leaves its last round's tables alone behind."""
    out = kept(df)
    dropped(*former)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` made and that nothing reads any more; one that is gone already doesn't matter."""
    for t in tables:
        files, at = _file_system(t.sparkSession, t._trellis_at)
        files.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
