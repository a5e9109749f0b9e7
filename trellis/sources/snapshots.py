"""Versioned tables: each write is a new snapshot, the newest counts, old ones are pruned.

A snapshot is complete once its folder has Spark's mark of success, so a reader never sees half of one; a write
that was cut off is passed over and removed by the next prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEEP = 20  # fixed value


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self, complete: bool = True) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        numbers = sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit())
        return [n for n in numbers if not complete or fs.exists(path(f"{self.path}/v{n:09d}/_SUCCESS"))]

    def read(self, version: int | None = None) -> DataFrame:
        there = self.versions()
        v = there[-1] if version is None and there else version
        if v is None or v not in there:
            raise FileNotFoundError(f"no snapshot {version if version is not None else ''} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{v:09d}")

    def write(self, df: DataFrame) -> int:
        v = max(self.versions(complete=False), default=0) + 1
        df.write.parquet(f"{self.path}/v{v:09d}")
        self.prune()
        return v

    def prune(self) -> list[int]:
        fs, path = self._fs()
        whole = self.versions()
        gone = [v for v in self.versions(complete=False) if v not in whole[-self.keep :] and (v in whole or not whole or v < whole[-1])]
        for v in gone:
            fs.delete(path(f"{self.path}/v{v:09d}"), True)
        return gone

    def restore(self, version: int) -> int:
        """Makes an old snapshot the newest; what was the newest stays below it."""
        return self.write(self.read(version))

    def upsert(self, changes: DataFrame, key: str) -> int:
        """A new snapshot with the rows of ``changes`` in place of those of the same key."""
        if not self.versions():
            return self.write(changes)
        return self.write(self.read().join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True))
