"""The folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the program ends.

    Where that is unset, a session of one machine gets a folder of its own, as in tests; on a
    cluster that is an error, as machines cannot see each other's folders.
    """
    setting = "spark.checkpoint.dir"
    base = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting)
    if not base:
        if not one_process(spark):
            raise ValueError(f"{setting} is not set; a cluster needs a folder that all its machines share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(setting, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _at_end() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            try:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session may be gone already
                return
