"""A table that a stream appends to exactly once, and rounds of a stream that may be cut short.

Every micro-batch is one partition, overwritten as a whole, so a batch that runs again replaces what it
wrote. A marker with the batch's number of rows follows the rows. What readers and a resumed run
trust is the shorter of the two: batches that have a marker and as many rows as it says.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class Interrupted(RuntimeError):
    """A run that was ended between the rows of a batch and its marker (for tests and drills)."""


class AppendTable:
    """``folder/rows/batch=N`` and ``folder/markers/N``; both survive the session."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, *parts: object):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, batch: DataFrame, number: int, interrupt: Callable[[int], bool] = lambda number: False) -> None:
        """Replace batch ``number`` and mark it; for ``foreachBatch``."""
        rows = batch.select(*[F.col(f"`{c}`") for c in self.schema.names]).withColumn("batch", F.lit(number).cast("long"))
        rows.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.folder}/rows")
        n = self._counts().get(number, 0)
        if interrupt(number):
            raise Interrupted(f"batch {number}")
        draft, fs = self._path(f".marker-{number}")
        out = fs.create(draft, True)
        out.writeBytes(json.dumps({"batch": number, "n": n}))
        out.close()
        marker, _ = self._path("markers", number)
        fs.mkdirs(marker.getParent())
        fs.delete(marker, False)
        fs.rename(draft, marker)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType(list(self.schema.fields)).add("batch", "long")).parquet(f"{self.folder}/rows")

    def _counts(self) -> dict[int, int]:
        """Rows of each batch that has any: a row for every batch, which is as many as there are markers."""
        where, fs = self._path("rows")
        return {r.batch: r["count"] for r in self._rows().groupBy("batch").count().collect()} if fs.exists(where) else {}

    def _markers(self) -> dict[int, int]:
        where, fs = self._path("markers")
        if not fs.exists(where):
            return {}
        return {r.batch: r.n for r in self.spark.read.schema("batch long, n long").json(f"{self.folder}/markers").collect() if r.batch is not None}

    def trusted(self) -> int:
        """The last batch up to which every batch is marked and whole; -1 if there is none."""
        markers, counts, last = self._markers(), self._counts(), -1
        while (last + 1) in markers and counts.get(last + 1, 0) == markers[last + 1]:
            last += 1
        return last

    def read(self) -> DataFrame:
        """The rows of all batches that are trusted."""
        where, fs = self._path("rows")
        if not fs.exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self._rows().where(F.col("batch") <= self.trusted()).drop("batch")

    def resume(self, checkpoint: str) -> int:
        """Take back what lies beyond the trusted batches, here and in the stream's own logs, so that the stream does it again."""
        last = self.trusted()
        for n in set(self._markers()) | set(self._counts()):
            if n > last:
                for parts in (("markers", n), ("rows", f"batch={n}")):
                    path, fs = self._path(*parts)
                    fs.delete(path, True)
        for log in ("commits", "offsets"):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/{log}")
            fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.listStatus(where) if fs.exists(where) else []:
                name = status.getPath().getName()
                if name.isdigit() and int(name) > last:
                    fs.delete(status.getPath(), False)
        return last


def run(stream: DataFrame, table: AppendTable, checkpoint: str, interrupt: Callable[[int], bool] = lambda number: False, mode: str = "append") -> list[dict]:
    """Bring ``stream`` to the end of what is there now, into ``table``; returns the progress of its batches. A run after an interrupted one goes on where that one's last whole batch ended."""
    table.resume(checkpoint)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: table.write(batch, number, interrupt)).start()
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") and not callable(p.json) else p for p in query.recentProgress]


def delivered(parts: list[DataFrame], form: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append") -> tuple[DataFrame, list[dict]]:
    """Write one part after another and run ``form`` over what has arrived so far, each time from the checkpoint of the time before.

    Returns the result table and the progress of all batches, in order.
    """
    spark, progress, table = parts[0].sparkSession, [], None
    session = spark.newSession()
    for k, v in ROCKS.items():
        session.conf.set(k, v)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    for k, part in enumerate(parts):
        part.write.mode("overwrite").parquet(f"{folder}/in/part={k}")
        arrived = session.readStream.schema(StructType(list(part.schema.fields)).add("part", "integer")).parquet(f"{folder}/in").drop("part")
        out = form(arrived)
        table = AppendTable(session, f"{folder}/out", out.schema)
        progress += run(out, table, f"{folder}/checkpoint", mode=mode)
    found = AppendTable(spark, table.folder, table.schema)
    return found.read(), progress


def behind(rows: DataFrame, seconds: int) -> datetime | None:
    """A time so long after the latest ``ts``."""
    last = rows.agg(F.max("ts").alias("t")).first().t
    return None if last is None else last + timedelta(seconds=seconds)


def by_time(rows: DataFrame, form: Callable[[DataFrame], DataFrame], folder: str, last: list[dict], deliveries: int = 2) -> DataFrame:
    """The result of ``form`` in append mode over ``rows``, which are cut by their ``ts`` and arrive one delivery after another; with the last come ``last``, rows that only move time on, their ``ts`` so many seconds after the latest.

    ``rows`` are worked out once and kept in ``folder``.
    """
    rows.write.parquet(f"{folder}/rows")
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    ms = F.unix_millis("ts")
    end = behind(rows, 0)
    last = [{**row, "ts": None if end is None else end + timedelta(seconds=row["ts"])} for row in last]
    cuts = rows.select(ms.alias("ms")).approxQuantile("ms", [k / deliveries for k in range(1, deliveries)], 0.01)
    edges = [None, *cuts, None]
    parts = [rows.where((F.lit(True) if a is None else ms >= a) & (F.lit(True) if b is None else ms < b)) for a, b in zip(edges, edges[1:])]
    loose = StructType([StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    if last:
        parts[-1] = parts[-1].unionByName(rows.sparkSession.createDataFrame([[row.get(c) for c in rows.columns] for row in last], loose))
    return delivered(parts, form, folder)[0]


#: Keyed state on disk, small partitions included.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
