"""Operator 9: mix sources to target weights by hash-random keys and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import deal_key, dealt, running
from .scratch import Scratch

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size`` -> + ``target``: shares of the whole by weight, each source at most
    ``most`` times its size, the excess shared anew by weight among the rest.

    Sources take the weights in code-point order, null last. The shares have a closed form:
    order sources by most * size / weight; those before the first that stays below its
    bound get the bound. Empty sources have target 0.
    """
    # one row per source: a table of the size of the source list
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").isNull(), F.col("source"))
    filling = every.orderBy("_level", "_w", F.col("source").isNull(), "source")
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(most))
        .withColumn("_level", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_fits", F.when(F.col("_left") <= F.col("_level") * F.col("_open"), F.col("_left") / F.col("_open")))
        .withColumn("_rate", F.first("_fits", ignorenulls=True).over(whole))  # the first that fits sets the rate of all after it
    )
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_rate") * F.col("_w"), F.col("_cap"))).cast("double").alias("target"))


def _plan(slim: DataFrame, keep: Scratch, weights: tuple[int, ...], most: float, ties: list[str]) -> DataFrame:
    """``doc_id, source, size, _key`` and ``ties`` -> what each row gives: ``epochs`` whole passes and ``rest`` words."""
    slim = dealt(slim, ["doc_id", "source", "size", "_key"], keep)
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    placed = running(slim, ["source"], deal_key(F.col("_key")), ["doc_id", "size", "_deal", *ties], "size", "_before", extra=goals)
    goal = F.floor(F.col("target") + 1e-6)
    return (
        placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("epochs") * F.col("source_size") - F.col("_before"))).cast("long"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("rest")).cast("long"))
    )


def _sizes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_key")]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of every document.

    Each source is put in the order of hash-random keys of its documents; a running sum of
    words then cuts it at its budget. A source whose target is k sizes and a rest gives every
    document k times, and the documents before the rest's cut once more; the document in
    which the cut falls gives only its first words, so a source gives floor(target) words
    exactly.

    Returns ``doc_id, size, source, source_size, target, taken, epochs`` and ``rest`` (words of
    the last, partial pass). Null or empty text: size 0, taken 0. Very long texts count whole; the
    cut may fall inside one. A null source is a source of its own, the last. Repeated rows count
    each; rows equal in id, source and text are interchangeable and spread over all buckets. An empty table gives an empty
    table.
    """
    keep = Scratch(docs.sparkSession, "mix")
    slim = docs.select(*_sizes(docs, seed, id_col, text_col, source_col))
    return _plan(slim, keep, weights, most, []).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "rest")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with the columns of ``docs``.

    A document taken in part is last in its source's order; its text is its first words, joined
    by one space. Documents without words leave. A null source is a source of its own, a null id
    an id like any other. Where several rows share id, text and source, all rows are first written
    with a number of their own, and each of them takes its own share; a cut between rows
    equal in every column falls at any of them.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "mix")
    named = docs.select(F.struct("*").alias("_row"), *_sizes(docs, seed, id_col, text_col, source_col))
    repeats = not named.groupBy("doc_id", "source", "_key").count().where("count > 1").isEmpty()
    if repeats:
        named = keep.save(named.withColumn("_other", F.xxhash64("_row")).withColumn("_m", F.monotonically_increasing_id()), "rows")
    ties = ["_other", "_m"] if repeats else []
    plan = _plan(named.select("doc_id", "source", "size", "_key", *ties), keep, weights, most, ties).where("taken > 0")
    key = ["_m"] if repeats else ["doc_id", "source", "_key"]
    plan = plan.select(*[F.col(c).alias(f"_p_{c}") for c in key], "epochs", "rest", "size")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    times = F.sequence(F.lit(1), (F.col("epochs") + (F.col("rest") > 0).cast("int")).cast("int"))
    rows = named.drop("size").join(plan, same).select("_row", "epochs", "rest", "size", F.explode(times).alias("_time"))
    words = F.array_remove(F.split(F.col(f"_row.{text_col}"), SPACE), "")
    cut = F.when((F.col("_time") > F.col("epochs")) & (F.col("rest") < F.col("size")), F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " ")).otherwise(F.col(f"_row.{text_col}"))
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"_row.{c}") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
