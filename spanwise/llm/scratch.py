"""Shared intermediate tables.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``, the folder that
every executor and the driver see. Only when that setting is empty (unit tests on one
machine) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []
_made = threading.local()  # a run's tables are those of its thread, so that runs in several threads leave each other's alone


def _list() -> list[str]:
    if not hasattr(_made, "bases"):
        _made.bases = []
    return _made.bases


def root(spark: SparkSession) -> str:
    """The shared folder named by the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "local-cluster" not in spark.sparkContext.master:
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="spanwise-"))
            atexit.register(_forget)
        return "file://" + _local_root[0]
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def _forget() -> None:
    import shutil

    for path in _local_root:
        shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Tables of one operator run; ``drop`` frees those that later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{root(spark)}/spanwise/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _list().append(self.base)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:02d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back; a lost executor costs no recomputation."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def mark() -> int:
    """A point in time of this thread for ``sweep``."""
    return len(_list())


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the tables of operators that this thread ran after the mark ``since``; what reads them must be written by now."""
    made = _list()
    for base in made[since:]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(base)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    del made[since:]
