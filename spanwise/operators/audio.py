"""Audio as rows: whole-track statistics, chunk grid, music dilation, weighted overlap-add."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import scalar

#: Fixed values of the chunk grid, in frames.
SEGMENT, STRIDE, LEAD = 114_660, 103_194, 22_050
MUSIC, NEAR_MUSIC = 0.15, 0.02


def stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``frames, mean, std`` with the sample deviation; 0 for a single row."""
    return df.groupBy(*by).agg(F.count(value).alias("frames"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def windows_of(n: int, size: int, count: int = 20) -> list[tuple[int, int]] | None:
    """Evenly spaced [start, end) windows, first at 0, last flush with the end; None means all rows."""
    if n <= 2 * count * size:
        return None
    return [(k * (n - size) // (count - 1), k * (n - size) // (count - 1) + size) for k in range(count)]


def _count() -> Column:
    return F.ceil((F.col("frames") + LEAD) / STRIDE).cast("int")


def _cells(rows: DataFrame) -> DataFrame:
    off = F.col("chunk") * STRIDE - LEAD
    return rows.select("track_id", "chunk", off.cast("long").alias("off"), (F.least(off + SEGMENT, F.col("frames")) - F.greatest(off, F.lit(0))).cast("long").alias("n"))


def chunk_grid(tracks: DataFrame) -> DataFrame:
    """``track_id, chunk, off, n``: chunks every STRIDE from -LEAD until the track's end.

    Tracks are dealt to tasks first: a small table of tracks, one task by its bytes, is thousands of chunks a row.
    """
    dealt = tracks.where("frames > 0").repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id")
    return _cells(dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), _count() - 1))))


def chunk_grid_by_lots(tracks: DataFrame, lot: int = 64) -> DataFrame:
    """The rows of ``chunk_grid`` in an order that columnar files keep small: lots of tracks of similar length, and in a lot chunk by chunk.

    ``chunk``, ``off`` and nearly always ``n`` are then runs of equal values, and the tracks of a lot repeat in the same
    order. Tracks are dealt by a key that the lots share, so lots are made where the tracks are.
    """
    tasks = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tracks.where("frames > 0").withColumn("_deal", F.pmod(F.xxhash64("track_id"), F.lit(8 * tasks))).repartition(tasks, "_deal")
    place = F.row_number().over(Window.partitionBy("_deal").orderBy("frames")) - 1  # of the tracks of one deal
    of = F.sort_array(F.collect_list(F.struct("frames", "track_id")), asc=False)
    part = lambda name: F.transform(of, lambda t: t[name]).alias(name)
    lots = dealt.withColumn("_lot", F.floor(place / lot)).groupBy("_deal", "_lot").agg(part("track_id"), part("frames"), F.max(_count()).alias("_n"))
    chunks = lots.select("track_id", "frames", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"))
    cells = chunks.coalesce(tasks).select("frames", "chunk", F.posexplode("track_id").alias("_p", "track_id"))  # as many tasks: fused with the step before, all rows of a lot would wait in memory
    return _cells(cells.select("chunk", "track_id", F.get("frames", F.col("_p")).alias("frames")).where(F.col("chunk") < _count()))


def dilate(scores: DataFrame, by: str, bucket: int = 4096) -> DataFrame:
    """Add ``separate``: music within one chunk, or within two if the chunk itself is not quite silent.

    A neighbour inside the track that was never scored forces separation; before its start and after its
    end is silence. Groups are cut into buckets of chunks; each bucket also gets two chunks of its
    neighbours, so a long track is many groups and the frames see what they need.
    """
    b = F.floor(F.col("chunk") / bucket)
    reach = F.array_distinct(F.array(F.floor((F.col("chunk") - 2) / bucket), b, F.floor((F.col("chunk") + 2) / bucket)))
    last = scores.groupBy(F.col(by).alias("_by")).agg(F.max("chunk").alias("_last"))  # a row per track
    wide = scores.withColumn("_own", b).withColumn("_b", F.explode(reach))
    order = Window.partitionBy(by, "_b").orderBy("chunk")
    near, far = F.max("score").over(order.rangeBetween(-1, 1)), F.max("score").over(order.rangeBetween(-2, 2))
    music, some = F.lit(MUSIC).cast("float"), F.lit(NEAR_MUSIC).cast("float")
    there = F.count("*").over(order.rangeBetween(-2, 2))
    out = wide.withColumn("_near", near).withColumn("_far", far).withColumn("_there", there).where("_b = _own").join(last, F.col(by).eqNullSafe(F.col("_by")))
    expected = F.least(F.col("_last"), F.col("chunk") + 2) - F.greatest(F.lit(0), F.col("chunk") - 2) + 1
    separate = (F.col("_there") < expected) | (F.col("_near") >= music) | ((F.col("score") >= some) & (F.col("_far") >= music))
    return out.withColumn("separate", separate).drop("_b", "_own", "_near", "_far", "_there", "_by", "_last")


def window_scores(samples: DataFrame, by: list[str], frame: int, silence: float = 0.001, score: Column | None = None) -> DataFrame:
    """``by, frames, score`` of each window ``by``: the best frame's score, 0 where no sample reaches ``silence``.

    ``samples``: by, ``j`` (0, 1, ... in the window) and ``x``. Frames follow each other, the last flush with
    the window's end; a window shorter than a frame is one frame, filled up with zeros. ``score`` is an aggregate of a
    frame's samples; by default their mean absolute value over the frame.
    """
    n = F.count("*").over(Window.partitionBy(*by))
    own = F.when((F.floor(F.col("j") / frame) + 1) * frame <= F.greatest("n", F.lit(frame)), F.floor(F.col("j") / frame) * frame)
    flush = F.when((F.col("n") > frame) & (F.col("n") % frame != 0) & (F.col("j") >= F.col("n") - frame), F.col("n") - frame)
    cells = samples.withColumn("n", n).withColumn("start", F.explode(F.filter(F.array(own, flush), lambda s: s.isNotNull())))
    scores = cells.groupBy(*by, "start").agg((F.sum(F.abs("x")) / frame if score is None else score).alias("s"), F.max(F.abs("x")).alias("p"))
    return scores.groupBy(*by).agg(F.count("*").alias("frames"), F.when(F.max("p") < silence, 0.0).otherwise(F.max("s")).alias("score"))


def skipped_chunks(done: Column, stride: int = STRIDE, lead: int = LEAD) -> Column:
    """Chunks that a run resumed after ``done`` frames need not compute; exactly one is computed again."""
    return F.greatest(F.lit(0).cast("long"), F.floor((done + lead) / stride) - 1)


def separate(samples: DataFrame, by: str, model, segment: int = SEGMENT, stride: int = STRIDE, lead: int = LEAD, done: DataFrame | None = None) -> DataFrame:
    """``by, i, l, r``: samples normalised, put through ``model`` chunk by chunk, added up and scaled back.

    ``samples``: by, i, l, r. ``model``: array (segment, 2) -> array (segment, 2), run for each chunk as
    an Arrow group of at most ``segment`` rows. The last chunk is shorter: it is read with real samples
    on its left and zeros elsewhere, and trimmed to its centre. ``done`` (by, ``written``): a resumed
    run, which computes only what later samples need and gives only these; they equal the full run's.
    """
    facts = samples.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"), F.avg((F.col("l") + F.col("r")) / 2).alias("_mean"), F.greatest(F.lit(1e-8), F.coalesce(F.stddev_samp((F.col("l") + F.col("r")) / 2), F.lit(0.0))).alias("_std"))
    if done is not None:
        facts = facts.join(done.select(F.col(by).alias("_d"), "written"), F.col("_by") == F.col("_d"), "left").drop("_d").withColumn("written", F.coalesce("written", F.lit(0)))
    else:
        facts = facts.withColumn("written", F.lit(0))
    facts = F.broadcast(facts.withColumn("_skip", skipped_chunks(F.col("written"), stride, lead)))  # a row per track; a shuffle would put each track in one task
    p, last = F.col("i") + lead, F.ceil((F.col("_n") + lead) / stride) - 1
    tail = F.floor((segment - F.least(F.lit(segment), F.col("_n") + lead - last * stride)) / 2)  # left context of the last chunk
    k = F.floor(p / stride)
    over = -(-segment // stride)
    ks = F.array(*[k - j for j in range(over)], *[k + 1 + j for j in range(over)])
    fits = lambda c: (c >= 0) & (c <= last) & (c >= F.col("_skip")) & (p - c * stride < segment) & (p - c * stride >= F.when(c == last, -tail).otherwise(0))
    cells = samples.join(facts, F.col(by) == F.col("_by")).withColumn("_k", F.explode(F.filter(ks, fits)))
    cells = cells.select(by, "_k", p.alias("_p"), ((F.col("l") - F.col("_mean")) / F.col("_std")).alias("l"), ((F.col("r") - F.col("_mean")) / F.col("_std")).alias("r"), (F.col("_n") + lead).alias("_end"))

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        off = int(key[1]) * stride
        size = min(segment, int(rows["_end"].iloc[0]) - off)
        left = (segment - size) // 2
        wave = np.zeros((segment, 2))
        at = rows["_p"].to_numpy() - (off - left)
        wave[at] = rows[["l", "r"]].to_numpy()
        out = model(wave)[left : left + size]
        j = np.arange(size)
        g = np.minimum(j + 1, segment - j) / (segment / 2)
        return pd.DataFrame({by: key[0], "i": off + j - lead, "gl": g * out[:, 0], "gr": g * out[:, 1], "g": g})[off + j >= lead]

    kind = samples.schema[by].dataType.simpleString()
    added = cells.groupBy(by, "_k").applyInPandas(chunk, f"{by} {kind}, i long, gl double, gr double, g double").groupBy(by, "i").agg(F.sum("gl").alias("gl"), F.sum("gr").alias("gr"), F.sum("g").alias("g"))
    back = added.join(facts, F.col(by) == F.col("_by")).where("i >= written")
    side = lambda c: scalar.finite_or_zero(scalar.soft_clip(F.col(c) / F.col("g") * F.col("_std") + F.col("_mean")))
    return back.select(by, "i", side("gl").alias("l"), side("gr").alias("r"))


def overlap_add(chunks: DataFrame, by: list[str], segment: int) -> DataFrame:
    """``pos, x``: sum(g * x) / sum(g) over chunks; g is a triangle over the segment.

    ``chunks``: by, ``off`` and the array ``x``. Sums combine before the shuffle.
    """
    cells = chunks.select(*by, "off", F.posexplode("x").alias("i", "x"))
    g = F.least(F.col("i") + 1, segment - F.col("i")) / (segment / 2)
    summed = cells.select(*by, (F.col("off") + F.col("i")).alias("pos"), (g * F.col("x")).alias("gx"), g.alias("g")).groupBy(*by, "pos").agg(F.sum("gx").alias("gx"), F.sum("g").alias("g"))
    return summed.select(*by, "pos", (F.col("gx") / F.col("g")).alias("x"))
