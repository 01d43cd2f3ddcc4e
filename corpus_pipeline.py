"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes every stage as Parquet in the shared folder and reads it
again, so no stage recomputes an earlier one and a lost executor costs one stage's tasks.

Every stage takes extra columns of any name, very long texts whole, and an empty table, which
gives an empty one. Rows are judged one by one: ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwise import ship
from spanwise.llm import decontaminate, minhash, mixing, quality, sharding
from spanwise.llm.scratch import Scratch, mark, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table. A null or empty text has no words and fails; equal rows pass or fail together."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates (five words, 0.8).

    Equal rows are a group and one stays. A null id is the last of its group. Null and empty texts are
    in no group and stay.
    """
    return minhash.deduplicated(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Equal texts are judged alike, whatever their ids; null and empty texts stay. An empty benchmark or
    null items take nothing out.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; documents of small sources repeat.

    A null source is one of its own, the last. Texts without words leave. Ties of the hash order
    are broken by id, size and the rest of the row.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, with the row itself in ``document``; equal rows, which repeat here, take a slot each."""
    return sharding.sharded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: SuperMinHash components and keyed permutations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    keep = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since, before = mark(), docs
        docs = keep.save(stage(spark, docs, sf_dir), f"stage-{k}")
        sweep(spark, since)  # the stage is written: what it made on the way, and what it read, can go
        keep.drop(before)
    return docs
