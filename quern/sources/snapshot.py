"""Versioned Parquet tables: a new snapshot is written beside the old, then a pointer to it is added.

Readers see one whole version; a write that fails leaves the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_pointers"


class Snapshot:
    """A table under a folder that Spark's file systems reach.

    The largest name in ``_pointers`` is its version.  Pointers are empty files that are made
    once and never moved or overwritten, so at every moment there is one to read, and a crash
    between two steps leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()) -> None:
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _pointers(self) -> list[str]:
        fs, where = self._fs(f"{self.path}/{POINTERS}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def current(self) -> str | None:
        return max(self._pointers(), default=None)

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame) -> str:
        old = self.current()
        number = 0 if old is None else int(old.split("-")[0][1:]) + 1
        version = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{version}")
        fs, pointer = self._fs(f"{self.path}/{POINTERS}/{version}")
        fs.create(pointer, False).close()
        return version

    def update(self, change: Callable[[DataFrame | None], DataFrame]) -> str:
        """Write what ``change`` makes of the current content."""
        return self.write(change(self.read()))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all versions but the newest ones; returns those deleted."""
        fs, where = self._fs(self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("v"))
        current = self.current()
        old = [n for n in names[: max(0, len(names) - keep)] if n != current]
        for n in old:
            for path, deep in ((f"{POINTERS}/{n}", False), (n, True)):  # the pointer first, so that none is left without its version
                fs.delete(self._fs(f"{self.path}/{path}")[1], deep)
        return old
