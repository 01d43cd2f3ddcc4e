"""Domain views over the driver's tables: frames, scores, faces, audio, jobs, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000
CLASSES = ("drawings", "hentai", "neutral", "porn", "sexy")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, video_id, user_id, pts_ms, value, k``. Timestamps carry no zone and count as UTC."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("video_id"), "user_id", F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) div 1000000").alias("pts_ms"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, video_id, pts_ms`` and one FLOAT probability per class."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("_n"))  # one row
    total = sum((F.abs(F.element_at("embedding", i).cast("double")) for i in range(1, 6)), F.lit(0.0))
    scores = vectors.select("vec_id", *[(F.abs(F.element_at("embedding", i).cast("double")) / total).cast("float").alias(c) for i, c in enumerate(CLASSES, 1)])
    ev = events(spark, sf_dir).crossJoin(F.broadcast(n))
    return ev.join(scores, F.col("vec_id") == F.col("event_id") % F.col("_n")).select("event_id", "video_id", "pts_ms", *CLASSES)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, video_id, pts_ms, tracking_id, l, t, r, b, px, vote``; no id where the detector gave none."""
    i = F.col("event_id")
    left, top = F.col("k") / F.lit(200.0), (i % 50) / F.lit(100.0)
    return events(spark, sf_dir).select(
        "event_id", "video_id", F.expr("((pts_ms div 100) div 100) * 100").alias("pts_ms"),
        F.when(i % 17 == 0, None).otherwise(F.col("user_id")).alias("tracking_id"),
        left.alias("l"), top.alias("t"), (left + F.lit(0.1) + (i % 7) / F.lit(50.0)).alias("r"), (top + F.lit(0.1) + (i % 5) / F.lit(50.0)).alias("b"),
        (F.lit(20) + i % 300).alias("px"), ((i * 7919) % 3 - 1).cast("int").alias("vote"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue item per order."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = (
        F.when(status == "F", F.when(key % 10 == 0, "FAILED").otherwise("DONE"))
        .when(status == "P", F.when(key % 2 == 0, "DOWNLOADING").otherwise("FILTERING"))
        .otherwise(F.when(key % 2 == 0, "PENDING_DOWNLOAD").otherwise("PENDING_FILTER"))
    )
    who = F.element_at(F.array(*[F.lit(w) for w in ("none", "women", " Men ", "bogus", "")]), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("https://h"), F.col("o_custkey") % 40, F.lit(".example.com/v/"), key % 500).alias("url"),
        F.floor(F.col("o_totalprice") * 20).cast("long").alias("duration_ms"), F.floor(F.col("o_totalprice") * 1000).cast("long").alias("source_bytes"),
        (key % 3 == 0).alias("remove_music"), who.alias("who_raw"), state.alias("state"), F.col("o_orderdate").alias("added"), F.col("o_custkey").alias("owner"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, tag, draft, prerelease``, one per part."""
    p = F.col("p_partkey")
    suffix = F.when(p % 3 == 0, "").when(p % 3 == 1, F.concat(F.lit("-beta"), p % 12)).otherwise(F.concat(F.lit("-rc"), p % 4))
    return table(spark, sf_dir, "part").select(p.alias("id"), F.concat(F.lit("v"), F.expr("p_size div 10"), F.lit("."), F.col("p_size") % 10, suffix).alias("tag"), (p % 11 == 0).alias("draft"), (p % 3 != 0).alias("prerelease"))
