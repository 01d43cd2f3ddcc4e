"""The slot rule over whole videos: emit a frame that reaches the slot, then move the slot.

The slot moves by one step, or to a step past the frame if that is not enough, so what a frame does
depends on all frames before it. A time bucket sees of its past only where the slot stands as it begins: less
than a step away on either side, or so far back that the first frame sets it anew. Each bucket
is therefore a table from its slot at the beginning to that at its end; tables of
consecutive buckets are composed 64 at a time, level by level, and the slots then handed down again.
No task holds a video.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_MS = 300_000
FAN = 64
_TABLE = "video_id string, node long, since long, until long, table array<int>"
_FOUND = "video_id string, node long, enters int"


def _moved(pts: np.ndarray, slots: np.ndarray, step: int) -> np.ndarray:
    """Where slots stand behind the frames ``pts`` (ascending)."""
    slots = slots.copy()
    while True:
        at = np.searchsorted(pts, slots)
        live = at < len(pts)
        if not live.any():
            return slots
        frame, following = pts[at[live]], slots[live] + step
        slots[live] = np.where(following <= frame, frame + step, following)


def _composed(tables: list[np.ndarray], since: list[int], until: list[int], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What enters each of consecutive tables, and what leaves the last, for every slot that enters the first. Behind a bucket without frames, two steps or more, the slot is far back (0)."""
    now, enters = np.arange(size), []
    for k, table in enumerate(tables):
        if k and since[k] != until[k - 1] + 1:
            now = np.zeros(size, np.int64)
        enters.append(now)
        now = table[now]
    return enters, now


def samples(frames: DataFrame, step: int, start: int | None = None, end: int | None = None, window: int | None = None) -> DataFrame:
    """``video_id, pts_ms`` of the frames that the slot rule emits.

    ``frames``: video_id, pts_ms. The first slot is ``start``, or each video's first frame; frames
    before ``start`` and from ``end`` on play no part. Frames of one time count once; null times are left out. ``window``
    (milliseconds, two steps at least) is the time bucket.
    """
    window = window or max(SEGMENT_MS, FAN * step)
    if not 0 < 2 * step <= window:
        raise ValueError("a bucket must be at least as long as two steps")
    origin, size = start or 0, 2 * step
    fit = F.col("pts_ms").isNotNull()
    for bound, keep in ((start, F.col("pts_ms") >= start), (end, F.col("pts_ms") < end)) if start is not None or end is not None else ():
        fit = fit & keep if bound is not None else fit
    rows = frames.where(fit).select("video_id", F.col("pts_ms").cast("long").alias("pts_ms"), F.floor((F.col("pts_ms") - origin) / window).alias("node"))

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        begin = origin + int(key[1]) * window
        after = _moved(np.unique(rows.pts_ms.to_numpy()), begin + np.arange(-step, step), step)
        return pd.DataFrame([(key[0], key[1], key[1], key[1], np.clip(after - begin - window, -step, step - 1) + step)], columns=["video_id", "node", "since", "until", "table"])

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        _, leaves = _composed(list(rows.table), list(rows.since), list(rows.until), size)
        return pd.DataFrame([(key[0], key[1], rows.since.iloc[0], rows.until.iloc[-1], leaves)], columns=["video_id", "node", "since", "until", "table"])

    def handed(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        enters, _ = _composed(list(rows.table), list(rows.since), list(rows.until), size)
        at = int(known.enters.iloc[0])
        return pd.DataFrame({"video_id": key[0], "node": rows.node.to_numpy(), "enters": [int(e[at]) for e in enters]})

    def emitted(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pts, out = np.unique(rows.pts_ms.to_numpy()), []
        slot = origin + int(key[1]) * window + int(known.enters.iloc[0]) - step
        while (k := int(np.searchsorted(pts, slot))) < len(pts):
            out.append(int(pts[k]))
            slot = slot + step if slot + step > pts[k] else out[-1] + step
        return pd.DataFrame({"video_id": key[0], "pts_ms": np.array(out, np.int64)})

    up: Column = F.floor(F.col("node") / FAN)
    levels = [rows.groupBy("video_id", "node").applyInPandas(table, _TABLE)]
    reach = rows.agg(F.min("node").alias("lo"), F.max("node").alias("hi")).first()  # two numbers
    lo, hi = reach.lo, reach.hi
    while lo is not None and lo != hi:
        levels.append(levels[-1].withColumn("up", up).groupBy("video_id", "up").applyInPandas(joined, _TABLE))
        lo, hi = lo // FAN, hi // FAN
    at_start = (F.lit(start is not None) & (F.col("since") == 0)).cast("int") * step  # else the first frame sets the slot
    known = levels[-1].select("video_id", "node", at_start.alias("enters"))
    for level in reversed(levels[:-1]):
        known = level.withColumn("up", up).groupBy("video_id", "up").cogroup(known.groupBy("video_id", "node")).applyInPandas(handed, _FOUND)
    return rows.groupBy("video_id", "node").cogroup(known.groupBy("video_id", "node")).applyInPandas(emitted, "video_id string, pts_ms long")
