"""Operator 6: reproducible shuffle into shards by a Feistel permutation of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feistel import permuted
from .ranks import deal_key, dealt, running
from .scratch import Scratch

KEY = 20240229


def row_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``row``, from 0: the rank of a row by a hash of ``columns``, then by their values.

    The rank depends on the rows alone, not on files or partitions. All the columns are hashed,
    so rows that share an id, or have none, are dealt by the rest; rows equal in all of them are
    dealt by ``_deal``.
    """
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return running(rows.withColumn("_1", F.lit(1).cast("long")), [], deal_key(key), [*columns, "_deal"], "_1", "row").drop("_1", "_deal")


def _slim(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _placed(slim: DataFrame, shards: int, key: int, more: list[str]) -> DataFrame:
    keep = Scratch(slim.sparkSession, "shard")
    slim = dealt(slim, ["doc_id", "size", "text_crc32"], keep)
    n = slim.count()
    return (
        row_numbers(slim, ["doc_id", "size", "text_crc32"])
        .withColumn("position", permuted(F.col("row"), n, key))
        .select(
            "doc_id", "size", "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("position") / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "row", "position", *more,
        )
    )


def shard(docs: DataFrame, shards: int = 24, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard and a slot.

    Returns one row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``
    (+ ``row``, the global row number, and ``position``, its place in the shuffle). Row number
    r goes to position p = permute(r); its shard is ``p % shards`` and its slot
    ``p // shards``, so both follow from r, the row count and the key alone. The law is
    ``rows``: counts per shard differ by one at most, slots run from 0 without gaps.

    Null text: size 8, crc32 of no bytes (0). Very long texts are rows like any other. Null or repeated ids keep a row each; rows equal
    in id, size and crc are interchangeable, and any number of them is spread over all buckets. An empty table gives an empty table. Other
    columns of the input play no part.
    """
    return _placed(docs.select(*_slim(id_col, text_col)), shards, key, [])


def sharded(docs: DataFrame, shards: int = 24, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``shard`` with each row itself, whole, in the struct column ``document``.

    The rows are written with a number of their own, shards and slots are worked out on the slim
    columns, and the two meet by number, so texts are shuffled once. A row that repeats takes a slot
    for each time. Columns of any name are safe inside ``document``. Nulls and empty tables as in ``shard``.
    """
    keep = Scratch(docs.sparkSession, "sharded")
    rows = keep.save(docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("_number")), "rows")
    slim = rows.select(*_slim(f"document.`{id_col}`", f"document.`{text_col}`"), "_number")
    placed = _placed(slim, shards, key, ["_number"]).withColumnRenamed("_number", "_p")
    return placed.join(rows, F.col("_p") == F.col("_number")).drop("_p", "_number")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
