"""Sends this package to the executors of a Spark context, once, for the few operators that run Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """The archive is made in a temporary folder of the driver; Spark's own file server hands it to each executor."""
    context = spark.sparkContext
    if getattr(context, "_trellis_sent", False):
        return
    top = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='trellis-code-')}/{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, os.path.relpath(f, top.parent))
    context.addPyFile(archive)
    context._trellis_sent = True
