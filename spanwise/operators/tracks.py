"""Face tracks: sessions, capped record-high votes, verdicts, spans, interpolated regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals

STALE_MS, PAD_MS, MIN_PX, MAX_VOTES, TOP = 2000, 50, 80, 5, 8


def previous_frames(frames: DataFrame, bucket: int = intervals.BUCKET) -> DataFrame:
    """``video_id, pts_ms, before``: the frame before each distinct frame, by buckets so that one long video is many groups."""
    distinct = frames.select("video_id", "pts_ms").distinct().withColumn("_b", F.floor(F.col("pts_ms") / bucket))
    last = distinct.groupBy("video_id", "_b").agg(F.max("pts_ms").alias("_last"))
    carried = last.select("video_id", "_b", F.lag("_last").over(Window.partitionBy("video_id").orderBy("_b")).alias("_carried"))
    inside = F.lag("pts_ms").over(Window.partitionBy("video_id", "_b").orderBy("pts_ms"))
    return distinct.withColumn("_in", inside).join(carried, ["video_id", "_b"]).select("video_id", "pts_ms", F.coalesce("_in", "_carried").alias("before"))


def sessions(faces: DataFrame) -> DataFrame:
    """Add ``track_key``. An id seen again starts a new track if a frame was sampled while it was 2 s stale.

    That is so exactly if the frame before the new detection is at least 2 s after the id's last
    detection. A detection without id is a track of its own.
    """
    known = faces.where("tracking_id is not null").join(previous_frames(faces), ["video_id", "pts_ms"])
    order = Window.partitionBy("video_id", "tracking_id").orderBy("pts_ms", "event_id")
    last = F.lag("pts_ms").over(order)
    split = known.withColumn("_new", F.coalesce(F.col("before") >= last + STALE_MS, last.isNull()).cast("int"))
    split = split.withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    named = split.withColumn("track_key", F.concat_ws(":", F.lit("id"), "tracking_id", "_s")).drop("before", "_new", "_s")
    lone = faces.where("tracking_id is null").withColumn("track_key", F.concat_ws(":", F.lit("one"), "event_id"))
    return named.unionByName(lone.select(*named.columns))


def should_censor(female: Column, male: Column, who: Column) -> Column:
    """Unknown and tied votes are censored; an unknown ``who`` means everyone."""
    return F.when(who == "women", ~(male > female)).when(who == "men", ~(female > male)).when(who == "none", F.lit(False)).otherwise(F.lit(True))


def votes(tracked: DataFrame) -> DataFrame:
    """Votes of each track: samples with an id and at least 80 px that beat all before, the first five."""
    order = Window.partitionBy("video_id", "track_key").orderBy("pts_ms", "event_id")
    fit = tracked.where((F.col("px") >= MIN_PX) & F.col("tracking_id").isNotNull())
    best = F.coalesce(F.max("px").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    records = fit.withColumn("_best", best).where("px > _best").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_VOTES)
    tally = records.groupBy("video_id", "track_key").agg(F.count_if(F.col("vote") == 1).alias("male"), F.count_if(F.col("vote") == -1).alias("female"), F.count("*").alias("tried"))
    every = tracked.select("video_id", "track_key").distinct()
    return every.join(tally, ["video_id", "track_key"], "left").na.fill(0, ["male", "female", "tried"])


def spans(tracked: DataFrame) -> DataFrame:
    """``video_id, track_key, start_ms, end_ms, n_keyframes``: first and last detection, 50 ms wider, from 0 on."""
    out = tracked.groupBy("video_id", "track_key").agg(F.min("pts_ms").alias("_lo"), F.max("pts_ms").alias("_hi"), F.count("*").alias("n_keyframes"))
    return out.select("video_id", "track_key", F.greatest(F.lit(0), F.col("_lo") - PAD_MS).alias("start_ms"), (F.col("_hi") + PAD_MS).alias("end_ms"), "n_keyframes")


def segments(tracked: DataFrame) -> DataFrame:
    """Keyframe segments ``s, e`` that cover a track's span once, with the rectangles at both ends.

    The first reaches back to the span's start; the last keeps its rectangle to the end. Of
    keyframes at one time the last counts.
    """
    order = Window.partitionBy("video_id", "track_key").orderBy("pts_ms", "event_id")
    nxt = {c: F.lead(c).over(order).alias(f"{c}1") for c in ("pts_ms", "l", "t", "r", "b")}
    rows = tracked.select("video_id", "track_key", "event_id", "pts_ms", "l", "t", "r", "b", F.row_number().over(order).alias("_n"), *nxt.values())
    rows = rows.where("pts_ms1 is null or pts_ms1 > pts_ms")
    first = F.row_number().over(order) == 1
    return rows.select("video_id", "track_key", "pts_ms", "l", "t", "r", "b", "pts_ms1", "l1", "t1", "r1", "b1",
                       F.when(first, F.greatest(F.lit(0), F.col("pts_ms") - PAD_MS)).otherwise(F.col("pts_ms")).alias("s"),
                       F.coalesce(F.col("pts_ms1") - 1, F.col("pts_ms") + PAD_MS).alias("e"))


def regions(frames: DataFrame, tracked: DataFrame, full: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` largest interpolated rectangles of every frame outside full-frame intervals."""
    open_frames = intervals.points_in(frames.select("video_id", "pts_ms").distinct(), full, ["video_id"], "pts_ms", "left_anti")
    hit = intervals.points_in(open_frames.withColumnRenamed("pts_ms", "at"), segments(tracked), ["video_id"], "at", "inner", 10_000)
    moving = (F.col("pts_ms1").isNotNull()) & (F.col("at") > F.col("pts_ms"))
    f = (F.col("at") - F.col("pts_ms")) / (F.col("pts_ms1") - F.col("pts_ms"))
    place = [(F.floor(F.when(moving, F.col(c) + (F.col(f"{c}1") - F.col(c)) * f).otherwise(F.col(c)) * 1e6 + 0.5) / 1e6).alias(c) for c in ("l", "t", "r", "b")]
    placed = hit.select("video_id", F.col("at").alias("pts_ms"), "track_key", *place)
    area = F.floor((F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) * 1e9 + 0.5)
    rank = F.row_number().over(Window.partitionBy("video_id", "pts_ms").orderBy(area.desc(), "track_key"))
    return placed.withColumn("rank", rank).where(F.col("rank") <= top)
