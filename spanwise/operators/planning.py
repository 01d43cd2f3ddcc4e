"""Segment plans, resume, slot sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

SEGMENT_MS, CONFIRM_MS = 300_000, 1_800_000


def segment_plan(videos: DataFrame, snap, forced_ms: int = 0) -> DataFrame:
    """``video_id, idx, start_ms, end_ms``: nominal cuts, snapped and clamped, equal ones collapsed.

    ``videos``: video_id, duration_ms; ``snap``: Column -> Column, monotone. No rows for short or
    unknown durations.
    """
    size = forced_ms or SEGMENT_MS
    fit = videos.where((F.col("duration_ms") > size) & (F.lit(forced_ms > 0) | (F.col("duration_ms") >= CONFIRM_MS)))
    count = F.ceil(F.col("duration_ms") / size).cast("int")
    inner = F.filter(F.sequence(F.lit(0), count), lambda i: (i >= 1) & (i < count))
    cut = F.transform(inner, lambda i: F.greatest(F.lit(0), F.least(F.col("duration_ms"), snap(i.cast("long") * size))))
    cuts = fit.select("video_id", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), cut, F.array(F.col("duration_ms"))))).alias("_c"))
    n = F.size("_c") - 1
    pairs = F.arrays_zip(F.slice("_c", F.lit(1), n).alias("start_ms"), F.slice("_c", F.lit(2), n).alias("end_ms"))
    return cuts.select("video_id", F.posexplode(pairs).alias("idx", "p")).select("video_id", "idx", "p.*")


def snapped_plan(videos: DataFrame, keyframes: DataFrame, size: int = SEGMENT_MS) -> DataFrame:
    """The plan with nominal cuts moved to the next keyframe ``video_id, t``; to the end where there is none.

    Nominal cuts are the multiples of ``size``, so what they move to are the first keyframes of the spans between
    them: one row per span with a keyframe is looked up, not one per cut. Every row is the end of a segment.
    """
    fit = videos.where((F.col("duration_ms") > size) & (F.col("duration_ms") >= CONFIRM_MS)).select("video_id", F.col("duration_ms").alias("end_ms"), F.col("duration_ms").alias("_d"))
    marks = keyframes.where(F.col("video_id").isNotNull() & (F.col("t") >= size)).select("video_id", F.floor(F.col("t") / size).alias("_i"), F.col("t").cast("long").alias("t"))
    first = marks.repartition("video_id", "_i").groupBy("video_id", "_i").agg(F.min("t").alias("end_ms"))  # few share a span: grouping before the exchange would only spill
    ends = fit.unionByName(first.select("video_id", "end_ms", F.lit(None).cast("long").alias("_d")))
    order = Window.partitionBy("video_id").orderBy("end_ms")  # the cuts of one video: its minutes / 5
    last = F.max("_d").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    start = F.coalesce(F.lag("end_ms").over(order), F.lit(0).cast("long"))
    out = ends.select("video_id", (F.dense_rank().over(order) - 1).alias("idx"), start.alias("start_ms"), "end_ms", last.alias("_last"))
    return out.where((F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") <= F.col("_last"))).drop("_last")


def pending(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Segments without a checkpoint."""
    return plan.join(done, ["video_id", "idx"], "left_anti")


#: use: (offset of its first frame from the segment's start, step, frames)
EVAL_RUNS = {"eval": (0, 200, 36), "calib": (7200, 4000, 10)}


def _run_length(use: str) -> Column:
    """Frames of ``use`` in a segment: those before its end."""
    off, step, most = EVAL_RUNS[use]
    return F.greatest(F.lit(0), F.least(F.lit(most), F.ceil((F.col("end_ms") - F.col("start_ms") - off) / step))).cast("long")


def eval_frames(plan: DataFrame) -> DataFrame:
    """``video_id, idx, k, pts_ms, use``: 36 evaluation frames every 200 ms from a segment's start, then ten for calibration every 4 s; none at or beyond its end."""

    def run(use: str) -> Column:
        off, step, most = EVAL_RUNS[use]
        return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.struct(k.cast("long").alias("k"), (F.col("start_ms") + off + k * step).alias("pts_ms"), F.lit(use).alias("use")))

    frames = F.concat(*map(run, EVAL_RUNS))
    return plan.withColumn("x", F.explode(frames)).where(F.col("x.pts_ms") < F.col("end_ms")).select("video_id", "idx", "x.k", "x.pts_ms", "x.use")


def eval_totals(plan: DataFrame) -> DataFrame:
    """``video_id, use, n, placed, first_ms, last_ms``: the frames of ``eval_frames`` added up for each video and use, ``placed`` being the sum of pts_ms * (k + 1).

    A segment's frames of one use are evenly spaced, so their sums follow from its start and their number: no row per frame.
    """
    sums = []
    for use, (off, step, _) in EVAL_RUNS.items():
        m, first = F.col(f"_{use}"), F.col("start_ms") + off
        # k + 1 adds up to m (m + 1) / 2 and k (k + 1) to (m - 1) m (m + 1) / 3
        placed = F.expr(f"(start_ms + {off}) * (_{use} * (_{use} + 1) div 2) + {step} * ((_{use} - 1) * _{use} * (_{use} + 1) div 3)")
        sums += [F.sum(m).alias(f"n_{use}"), F.sum(placed).alias(f"placed_{use}"), F.min(F.when(m > 0, first)).alias(f"first_{use}"), F.max(F.when(m > 0, first + (m - 1) * step)).alias(f"last_{use}")]
    runs = plan.select("video_id", "start_ms", *[_run_length(use).alias(f"_{use}") for use in EVAL_RUNS])
    totals = runs.groupBy("video_id").agg(*sums)
    uses = F.array(*[F.struct(F.lit(use).alias("use"), *[F.col(f"{c}_{use}").alias(a) for c, a in (("n", "n"), ("placed", "placed"), ("first", "first_ms"), ("last", "last_ms"))]) for use in EVAL_RUNS])
    return totals.select("video_id", F.explode(uses).alias("x")).where("x.n > 0").select("video_id", "x.*")


def slot_samples(frames: DataFrame, step: int, window_ms: int = SEGMENT_MS) -> DataFrame:
    """Frames emitted by the slot rule, per window anchored at its start.

    A frame is emitted when it reaches the next slot; the slot then moves by one step, or to a
    step past the frame if that is not enough. The rule is a fold over the frames in order; a
    window bounds what one fold holds.
    """
    grouped = frames.select("video_id", "pts_ms", F.floor(F.col("pts_ms") / window_ms).alias("_w")).groupBy("video_id", "_w").agg(F.array_sort(F.collect_list("pts_ms")).alias("_f"))
    start = F.struct((F.col("_w") * window_ms).cast("long").alias("slot"), F.array().cast("array<bigint>").alias("out"))

    def move(state: Column, pts: Column) -> Column:
        following = state["slot"] + step
        return F.when(pts < state["slot"], state).otherwise(F.struct(F.when(following <= pts, pts + step).otherwise(following).alias("slot"), F.concat(state["out"], F.array(pts)).alias("out")))

    return grouped.select("video_id", F.explode(F.aggregate("_f", start, move, lambda s: s["out"])).alias("pts_ms"))


def strided(frames: DataFrame, every: int, by: str = "video_id", bucket: int = 10_000) -> DataFrame:
    """Every n-th frame in time order."""
    return numbered(frames, [by], F.floor(F.col("pts_ms") / bucket), ["pts_ms", "event_id"], "_n").where(F.col("_n") % every == 0).drop("_n")
