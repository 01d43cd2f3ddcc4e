"""Global row numbers and prefix sums without a global sort in one task.

Rows are ordered by a 64-bit hash of their key. Such hashes are uniform, so their top bits
deal the rows into equal buckets by a rule that no sampling and no rerun changes. Sums per
bucket give each bucket's start; a window inside each bucket does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

#: Equal rows that share a key, and so a bucket; further ones get keys of their own.
LOT = 4096
CROWD_BYTES = 64 << 20


def dealt(rows: DataFrame, columns: list[str], keep: Scratch, lot: int = LOT) -> DataFrame:
    """``rows``, written once, + ``_deal``: of rows equal in ``columns``, the first ``lot`` have 0, the next 1, and so on.

    A key hashed with ``_deal`` then spreads any number of equal rows over all buckets. Groups of over
    ``lot`` rows are rows / lot at most; their rows are numbered by buckets of their own, so none is gathered.
    """
    rows = keep.save(rows.withColumn("_n0", F.monotonically_increasing_id()), "dealt")
    crowds = keep.save(rows.groupBy(*columns).count().where(F.col("count") > lot).select(*[F.col(c).alias(f"_c_{c}") for c in columns]), "crowds")
    if crowds.isEmpty():
        return rows.withColumn("_deal", F.lit(0).cast("long")).drop("_n0")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    few = maybe_broadcast(crowds, CROWD_BYTES)
    crowded = rows.join(few, same, "left_semi").withColumn("_u", F.lit(1).cast("long"))
    crowded = running(crowded, columns, F.xxhash64("_n0"), ["_n0"], "_u", "_before").withColumn("_deal", F.floor(F.col("_before") / lot).cast("long"))
    calm = rows.join(few, same, "left_anti").withColumn("_deal", F.lit(0).cast("long"))
    return calm.unionByName(crowded.drop("_u", "_before")).drop("_n0")


def deal_key(key: Column) -> Column:
    """``key`` for the first lot of equal rows, a key of its own for each further lot."""
    return F.when(F.col("_deal") > 0, F.xxhash64(key, F.col("_deal"))).otherwise(key)


def running(df: DataFrame, by: list[str], key: Column, ties: list[str], amount: str, out: str, bits: int = 12, extra: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows before this one, per ``by``.

    The order is that of ``key`` (uniform 64-bit hashes), then of ``ties``. Rows equal in all of
    these are interchangeable; ``dealt`` keeps many of them from one bucket. Buckets hold rows / 2**bits rows each; one ``by`` group of any
    size is spread over all buckets. ``extra``: one row per ``by`` group, whose other columns
    the result gets; they travel with the bucket starts, so that no large group meets in a join.
    """
    df = df.withColumn("_h", key).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    sums = df.groupBy(*by, "_b").agg(F.sum(amount).alias("_s"))
    if by:
        to = Window.partitionBy(*by)
    else:  # 2**bits rows at most
        sums, to = sums.withColumn("_one", F.lit(0)), Window.partitionBy("_one")
    to = to.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    more = [c for c in extra.columns if c not in by] if extra is not None else []
    if extra is not None:
        extra = extra.select(*[F.col(c).alias(f"_e_{c}") for c in by], *more)
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    starts = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_k_b"), F.coalesce(F.sum("_s").over(to), F.lit(0)).alias("_start"), *by)
    if extra is not None:
        starts = starts.join(extra, on, "left")
    starts = starts.select(*[f"_k_{c}" for c in by], "_k_b", "_start", *more)
    same = F.col("_b") == F.col("_k_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    if not by:
        starts = F.broadcast(starts)  # 2**bits rows at most
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, same, "left")
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_h", "_b", "_k_b", "_start", "_in", *[f"_k_{c}" for c in by])
    )
