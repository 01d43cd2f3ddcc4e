"""Checkpoint documents of segments as files: one small JSON document a folder, some of them broken or missing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "startMs long, endMs long, events array<struct<s:long,e:long>>"
KEY = ["video_id", "idx"]
NONE = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the folder of a null


def _tasks(spark: SparkSession) -> int:
    """A number of its own, as documents are small and many: by their bytes alone they would be one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(documents: DataFrame, folder: str) -> None:
    """``video_id, idx, body``: each body as a file of its own; documents that are there already are replaced, others stay.

    Tasks write their documents themselves, as the driver would otherwise move every folder to its place, one after another. A file is
    written beside its folder and moved there, so what exists is whole unless it was harmed later; a task that runs again replaces
    what it wrote. ``folder`` is a local or HDFS address, as for the shards.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        draft = f"{base}/_drafts"
        where.create_dir(draft, recursive=True)
        for batch in batches:
            for video, idx, bodies in zip(*(batch.column(c).to_pylist() for c in (*KEY, "bodies"))):
                place = f"{base}/video_id={NONE if video is None else video}/idx={NONE if idx is None else idx}"
                where.create_dir(place, recursive=True)
                where.delete_dir_contents(place)
                for k, body in enumerate(bodies):
                    name = f"{draft}/{uuid.uuid4().hex}"
                    with where.open_output_stream(name) as out:
                        out.write(body.encode())
                    where.move(name, f"{place}/document-{k}.txt")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = documents.select(*KEY, F.coalesce("body", F.lit("")).alias("body")).repartition(_tasks(documents.sparkSession), *KEY)
    rows.groupBy(*KEY).agg(F.collect_list("body").alias("bodies")).mapInArrow(store, "n long").agg(F.sum("n")).first()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``video_id, idx, value, bytes, changed`` of every file: one task lists the folders of videos, and each of them is read by a task."""
    schema = pa.schema([("video_id", pa.int64()), ("idx", pa.int64()), ("value", pa.string()), ("bytes", pa.int64()), ("changed", pa.timestamp("us", "UTC"))])

    def videos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        for _ in (batch for batch in batches if batch.num_rows):
            found = [i.base_name for i in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith("video_id=")]
            for k in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pydict({"name": found[k : k + 10_000]})

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        number = lambda name: None if name.endswith(NONE) else int(unquote(name.partition("=")[2]))
        for batch in batches:
            rows, size = [], 0
            for name in batch.column("name").to_pylist():
                for info in where.get_file_info(fs.FileSelector(f"{base}/{name}", recursive=True)):
                    if info.type != fs.FileType.File or info.base_name[0] in "._":
                        continue
                    with where.open_input_stream(info.path) as source:
                        text = source.read().decode(errors="replace")
                    rows.append((number(name), number(info.path.rsplit("/", 2)[1]), text, info.size, info.mtime))
                    size += info.size
                    if len(rows) == 10_000 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    names = spark.range(0, 1, 1, 1).mapInArrow(videos, "name string").repartition(_tasks(spark), "name")
    return names.mapInArrow(documents, "video_id long, idx long, value string, bytes long, changed timestamp")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``video_id, idx, bytes, changed, document`` of every document below ``folder``.

    A document that is not JSON, or lacks a field, or whose end is not behind its start, is null. A
    key with several files counts as broken, as none of them can be trusted.
    """
    files = _files(spark, folder)
    parsed = F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"})
    sound = parsed["startMs"].isNotNull() & parsed["endMs"].isNotNull() & parsed["events"].isNotNull() & (parsed["endMs"] > parsed["startMs"]) & ~F.exists(parsed["events"], lambda x: x["s"].isNull() | x["e"].isNull())
    rows = files.select(*KEY, "bytes", "changed", F.when(sound, parsed).alias("document"))
    return rows.groupBy(*KEY).agg(F.sum("bytes").alias("bytes"), F.max("changed").alias("changed"), F.when(F.count("*") == 1, F.first("document")).alias("document"))


def state(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """``plan`` (video_id, idx, start_ms, end_ms) with ``state``: missing, corrupt, other (of another plan) or done, and the document."""
    found = documents.select(*[F.col(c).alias(f"_{c}") for c in KEY], "bytes", "document")
    joined = plan.join(found, (F.col("video_id") == F.col("_video_id")) & (F.col("idx") == F.col("_idx")), "left")
    fits = (F.col("document.startMs") == F.col("start_ms")) & (F.col("document.endMs") == F.col("end_ms"))
    what = F.when(F.col("_idx").isNull(), "missing").when(F.col("document").isNull(), "corrupt").when(~fits, "other").otherwise("done")
    return joined.select(*plan.columns, what.alias("state"), "bytes", "document")


def stale(folders: DataFrame, now: Column, age_ms: int) -> DataFrame:
    """``folders``: name, ``changed`` (of its newest file, null if it has none) and ``made`` (the folder's own time).

    A folder goes by its newest file and, where it has none, by its own time; one without any time is not stale.
    """
    last = F.coalesce("changed", "made")
    return folders.withColumn("stale", F.coalesce(F.unix_millis(now) - F.unix_millis(last) > age_ms, F.lit(False)))
