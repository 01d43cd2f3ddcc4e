"""Operator 12: exact duplicates by a stream whose keyed state never expires.

Arriving texts are first written to an index of digest, id and locator (file and row of the text).
A streaming aggregation over that index keeps, on disk, one state row per digest: the first row's id
and locator, and the number of rows. Rows that hit a digest seen before are compared with the text at
its locator, byte for byte. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

BLANKS = "[\\x20\\x09-\\x0D]+"
PLACE = ["file", "row"]
#: Rows of one group that are compared with one copy of its first text; larger groups get more copies.
ROWS_A_COPY = 4096
BROADCAST_BYTES = 32 << 20
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes that it does not fill
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # one run reads its state once; nothing stays open behind it
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Seen:
    """The state of a deduplication below ``folder``; it outlives the session.

    ``add`` may be called for one folder of texts after another, and again after a failure: a folder
    is indexed once, and a micro-batch that runs again overwrites what it wrote. ``partitions`` is the
    number of state partitions, fixed when the state is made (the session's shuffle partitions by
    default). ``batch_bytes`` bounds the index bytes of a micro-batch.
    """

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, partitions: int | None = None, batch_bytes: int = 64 << 30):
        self.spark, self.folder, self.id_col, self.text_col, self.digest, self.batch_bytes = spark, folder.rstrip("/"), id_col, text_col, digest, batch_bytes
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def texts(self, path: str) -> DataFrame:
        """``digest, id, file, row, body`` of the Parquet texts at ``path``."""
        table = self.spark.read.parquet(path)
        place = table.metadataColumn("_metadata")
        body = normalised(F.col(f"`{self.text_col}`"))
        rows = table.select(body.alias("body"), F.col(f"`{self.id_col}`").alias("id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
        return rows.select(self.digest(F.col("body")).alias("digest"), "id", *PLACE, "body")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def add(self, path: str, name: str) -> None:
        """Take in the texts at ``path``; ``name`` tells this delivery from others."""
        index = f"{self.folder}/index/delivery={name}"
        if not self._exists(f"{index}/_SUCCESS"):
            self.texts(path).drop("body").write.mode("overwrite").parquet(index)
        session = self.spark.newSession()
        for k, v in (STATE | {"spark.sql.shuffle.partitions": str(self.partitions)}).items():
            session.conf.set(k, v)
        rows = self.index().schema
        stream = session.readStream.schema(rows).option("maxBytesPerTrigger", self.batch_bytes).parquet(f"{self.folder}/index")
        first = F.struct(F.col("id").isNull().alias("nameless"), "id", *PLACE)
        state = stream.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))

        def changed(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/groups/batch={number}")

        state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/state").foreachBatch(changed).start().awaitTermination()

    def index(self) -> DataFrame:
        """``digest, id, file, row, delivery`` of every row taken in."""
        return self.spark.read.parquet(f"{self.folder}/index").withColumn("delivery", F.col("delivery").cast("string"))

    def groups(self) -> DataFrame:
        """``digest, first, n``: the state as of now, the latest row of each digest."""
        rows = self.spark.read.parquet(f"{self.folder}/groups")
        latest = rows.groupBy("digest").agg(F.max(F.struct("batch", "n", "first")).alias("s"))
        return latest.select("digest", "s.first", "s.n")


def _compared(seen: Seen, paths: list[str], groups: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts of all groups of two and more, and the digests among them that more than one text has."""
    many = keep.save(groups.where("n > 1").select(F.col("digest").alias("_d"), "first", "n"), "many")
    few = maybe_broadcast(many, BROADCAST_BYTES)
    texts = None
    for path in paths:
        part = seen.texts(path).join(few, F.col("digest") == F.col("_d")).drop("_d")
        texts = part if texts is None else texts.unionByName(part)
    copies = F.ceil(F.col("n") / ROWS_A_COPY).cast("int")
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    texts = keep.save(texts.withColumn("copies", copies).withColumn("is_first", is_first), "texts")
    firsts = texts.where("is_first").select(F.col("digest").alias("_d"), F.col("body").alias("_body"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy"))
    hits = texts.where("not is_first").withColumn("copy", F.pmod(F.xxhash64(*PLACE), F.col("copies")).cast("int"))
    unlike = hits.join(firsts, (F.col("digest") == F.col("_d")) & (F.col("copy") == F.col("_copy"))).where("body <> _body")
    return texts, keep.save(unlike.select("digest").distinct(), "unlike")


def report(spark: SparkSession, path: str | list[str], id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = 64 << 30) -> DataFrame:
    """Which rows of the Parquet texts at ``path`` (one folder, or several taken in one after another) stay.

    Returns one row per row: ``id, keep_id, group_size, kept, digest, file, row``. Texts are equal if
    they are the same after each run of blanks became one space; a null text is an empty one. The row of
    the least id stays; null ids come last, and of rows that share the least id the first by file and row
    stays, so exactly one row of a group is kept. Very long texts are compared whole. Different texts
    under one digest are told apart by their bytes and grouped by these. Empty tables give an empty result.
    Only the two named columns are read, whatever else the table has.
    """
    keep = Scratch(spark, "exact")
    paths = [path] if isinstance(path, str) else list(path)
    seen = Seen(spark, f"{keep.base}/seen", id_col, text_col, digest, batch_bytes=batch_bytes)
    for k, p in enumerate(paths):
        seen.add(p, str(k))
    groups = keep.save(seen.groups(), "groups")
    texts, unlike = _compared(seen, paths, groups, keep)
    index = seen.index().drop("delivery")
    sound, named = groups, []
    if not unlike.isEmpty():  # one digest, several texts: group these by the texts themselves
        apart = texts.join(F.broadcast(unlike) if unlike.count() < 10_000 else unlike, "digest")
        first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", *PLACE)).alias("_first")
        by_text = apart.groupBy(F.col("digest").alias("_d"), F.col("body").alias("_body")).agg(first, F.count("*").alias("_n"))
        named = [apart.join(by_text, (F.col("digest") == F.col("_d")) & (F.col("body") == F.col("_body"))).select("digest", "id", *PLACE, F.col("_first").alias("first"), F.col("_n").alias("n"))]
        sound = groups.join(unlike, "digest", "left_anti")
    rows = index.join(sound, "digest").select("digest", "id", *PLACE, "first", "n")
    for more in named:
        rows = rows.unionByName(more)
    kept = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    out = rows.select("id", F.col("first.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), kept.alias("kept"), "digest", *PLACE)
    if not named:
        keep.drop(texts)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; see ``report``. The rows are written once, so that each has a locator."""
    keep = Scratch(docs.sparkSession, "exact-rows")
    path = keep.path("rows")
    docs.write.parquet(path)
    stay = report(docs.sparkSession, path, id_col, text_col).where("kept").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    table = docs.sparkSession.read.schema(docs.schema).parquet(path)
    place = table.metadataColumn("_metadata")
    rows = table.select(F.struct("*").alias("_all"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    rows = rows.join(stay, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")), "left_semi")
    return rows.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(spark, f"{sf_dir}/documents.parquet")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""
