"""Interval algebra on inclusive integer intervals ``s, e`` per group.

A group may hold a large share of all rows, so windows run inside time buckets; what a bucket must
know of the others is worked out on one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 300_000


def _carried(df: DataFrame, by: list[str], what: Column, ahead: bool = False) -> DataFrame:
    """``by, _b, _carried``: of each bucket the greatest ``what`` of all buckets before it, or with ``ahead`` the least of all behind it.

    ``what`` is an aggregate. The window runs over one row per bucket, not over the rows of a group.
    """
    summary = df.groupBy(*by, "_b").agg(what.alias("_w"))
    order = Window.partitionBy(*by).orderBy(F.col("_b").desc() if ahead else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(c).alias(f"_k_{c}") for c in (*by, "_b")]
    return summary.select(*names, (F.min("_w") if ahead else F.max("_w")).over(order).alias("_carried"))


def _beside(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    same = F.lit(True)
    for c in (*by, "_b"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(summary, same).drop(*[f"_k_{c}" for c in (*by, "_b")])


def merge(df: DataFrame, bridge: int, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """Intervals joined while the next starts at most ``bridge`` after the furthest end so far.

    Islands inside each start bucket come first. The furthest end before one of them is the greater of that
    inside its bucket and that of all earlier buckets; merged islands are numbered likewise, by a number per
    bucket and a count inside. All steps share the one exchange of the rows.
    """
    inside = Window.partitionBy(*by, "_b").orderBy("s", "e")
    rows = df.select(*by, "s", "e", F.floor(F.col("s") / bucket).alias("_b"))
    own = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (own.isNull() | (F.col("s") > own + bridge)).cast("int"))
    rows = rows.withColumn("_i", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_b", "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")
    reach = F.greatest(F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))  # nulls count for nothing
    marked = _beside(rows, _carried(rows, by, F.max("e")), by).withColumn("_reach", reach)
    marked = marked.select(*by, "_b", "s", "e", (F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + bridge)).cast("long").alias("_new"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    begun = marked.groupBy(*by, "_b").agg(F.sum("_new").alias("_n")).select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_b")], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begun"))
    numbered = _beside(marked.withColumn("_in", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))), begun, by)
    return numbered.groupBy(*by, (F.col("_begun") + F.col("_in")).alias("_i")).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def at_least(df: DataFrame, length: int) -> DataFrame:
    """Intervals of e - s >= length; to be used after merging."""
    return df.where(F.col("e") - F.col("s") >= length)


def overlaps(df: DataFrame, limit: int, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """Maximal runs ``s, e`` in which more than ``limit`` intervals are active at once.

    All changes of one instant count together. The running count is a start per bucket plus a
    sum inside the bucket; a run begins where the count rises above the limit.
    """
    deltas = df.select(*by, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = deltas.select(*by, "x.t", "x.d").groupBy(*by, "t").agg(F.sum("d").alias("d")).withColumn("_b", F.floor(F.col("t") / bucket))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.groupBy(*by, "_b").agg(F.sum("d").alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    active = F.col("_start") + F.col("_in")
    turns = steps.withColumn("_in", F.sum("d").over(inside)).join(starts, [*by, "_b"]).select(*by, "t", (active > limit).alias("hot"), (active - F.col("d") > limit).alias("was")).where("hot <> was")
    turns = turns.withColumn("_b", F.floor(F.col("t") / bucket))
    following = F.lead("t").over(Window.partitionBy(*by, "_b").orderBy("t"))  # runs begin and end in turn
    paired = _beside(turns.withColumn("_next", following), _carried(turns, by, F.min("t"), ahead=True), by)
    return paired.where("hot").select(*by, F.col("t").alias("s"), (F.coalesce("_next", "_carried") - 1).alias("e"))


def _bucketed(intervals: DataFrame, bucket: int) -> DataFrame:
    return intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))))


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], point: str, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Points inside inclusive intervals: ``how`` inner, left_semi or left_anti.

    Both sides meet on group and time bucket, an equi join with the exact range as a residual.
    Merge intervals first where they overlap much.
    """
    right = _bucketed(intervals, bucket)
    for c in by:
        right = right.withColumnRenamed(c, f"_{c}")
    on = F.col("_pb") == F.col("_b")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    on = on & (F.col(point) >= F.col("s")) & (F.col(point) <= F.col("e"))
    return points.withColumn("_pb", F.floor(F.col(point) / bucket)).join(right, on, how).drop("_pb", "_b", *[f"_{c}" for c in by])


def intersections(a: DataFrame, b: DataFrame, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """Common parts ``s, e`` of intervals of both sides, each pair once."""
    left = _bucketed(a.select(*by, F.col("s").alias("s"), F.col("e").alias("e")), bucket).select(*by, "_b", F.col("s").alias("_s1"), F.col("e").alias("_e1"))
    right = _bucketed(b.select(*by, "s", "e"), bucket).select(*by, "_b", F.col("s").alias("_s2"), F.col("e").alias("_e2"))
    both = left.join(right, [*by, "_b"]).where((F.col("_s1") <= F.col("_e2")) & (F.col("_s2") <= F.col("_e1")))
    start = F.greatest("_s1", "_s2")
    return both.where(F.col("_b") == F.floor(start / bucket)).select(*by, start.alias("s"), F.least("_e1", "_e2").alias("e"))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """``n_intervals, covered`` per group; ends are inclusive."""
    return df.groupBy(*by).agg(F.count("*").alias("n_intervals"), F.sum(F.col("e") - F.col("s") + 1).alias("covered"))


def next_at(points: DataFrame, marks: DataFrame, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """Add ``next``: the least mark ``t`` at or after each point's ``t``, or null. An as-of join by buckets.

    Inside a bucket, points and marks are one ordered stream; where a bucket has no later mark, the
    first mark of a later bucket counts, found on a table of one row per bucket.
    """
    names = [c for c in points.columns if c not in (*by, "t")]
    left = points.select(*by, "t", F.lit(None).cast("long").alias("_m"), F.struct(*[F.col(c) for c in names], F.lit(True).alias("_p")).alias("_row"))
    empty = F.lit(None).cast(left.schema["_row"].dataType)
    stream = left.unionByName(marks.select(*by, "t", F.col("t").cast("long").alias("_m"), empty.alias("_row"))).withColumn("_b", F.floor(F.col("t") / bucket))
    inside = Window.partitionBy(*by, "_b").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = stream.groupBy(*by, "_b").agg(F.min("_m").alias("_f")).select(*by, "_b", F.min("_f").over(later).alias("_later"))
    found = stream.withColumn("_own", F.min("_m").over(inside)).where("_row is not null").join(buckets, [*by, "_b"])
    return found.select(*by, "t", *[F.col(f"_row.{c}").alias(c) for c in names], F.coalesce("_own", "_later").alias("next"))
