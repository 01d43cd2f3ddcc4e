"""Row numbers and running sums per group without one task per group.

Rows are dealt by a bucket that follows the order (a time bucket, say). Sums per bucket give
each bucket's start; a window inside the bucket does the rest, so one group may hold a large
share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], bucket: Column, order: list[str], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over earlier rows of the group; ``bucket`` must not fall along ``order``."""
    df = df.withColumn("_b", bucket).withColumn("_v", amount)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, "_b").agg(F.sum("_v").alias("_s"))
    starts = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_k_b"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_b") == F.col("_k_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = df.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(starts, same)
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_b", "_v", "_in", "_start", "_k_b", *[f"_k_{c}" for c in by])


def numbered(df: DataFrame, by: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the row's number from 0 in its group."""
    return running(df, by, bucket, order, F.lit(1).cast("long"), name)


def changes(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from that of the row before in the group; a first row counts as one."""
    df = df.withColumn("_b", bucket)
    last = df.groupBy(*by, "_b").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_k_b"), F.lag("_last").over(Window.partitionBy(*by).orderBy("_b")).alias("_carried"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    same = F.col("_b") == F.col("_k_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = df.withColumn("_own", F.lag(F.struct(value)).over(inside)).join(carried, same).withColumn("_was", F.coalesce("_own", "_carried"))
    return out.where(F.col("_was").isNull() | ~F.col(f"_was.{value}").eqNullSafe(F.col(value))).drop("_b", "_own", "_was", "_carried", "_k_b", *[f"_k_{c}" for c in by])
