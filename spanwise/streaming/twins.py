"""Streaming forms of batch operators. Event time is the frame time; late rows past the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.audio import MUSIC, NEAR_MUSIC
from spanwise.operators.gate import LEAD_MS, LINGER_MS


def hysteresis(fired: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Merged intervals of firings ``video_id, ts``. Two firings share one exactly if they are at most 2001 ms apart."""
    session = fired.withWatermark("ts", delay).groupBy("video_id", F.session_window("ts", f"{LEAD_MS + LINGER_MS + 1} milliseconds"))
    spans = session.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    return spans.select("video_id", (F.unix_millis("_lo") - LEAD_MS).alias("s"), (F.unix_millis("_hi") + LINGER_MS).alias("e"))


def track_spans(faces: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Tracks ``video_id, tracking_id`` closed once an id was not seen for two seconds of frame time.

    A session window joins rows that are at most its gap apart, so the gap is a millisecond less.
    Rows later than the watermark are dropped.
    """
    session = faces.withWatermark("ts", delay).groupBy("video_id", "tracking_id", F.session_window("ts", "1999 milliseconds"))
    return session.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def segments(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Frames per nominal five-minute segment."""
    return frames.withWatermark("ts", delay).groupBy("video_id", F.window("ts", "5 minutes")).agg(F.count("*").alias("n"))


def hops(frames: DataFrame, size: str, step: str, delay: str = "10 seconds") -> DataFrame:
    """Frames per hopping window."""
    return frames.withWatermark("ts", delay).groupBy("video_id", F.window("ts", size, step)).agg(F.count("*").alias("n"))


def deduped(jobs: DataFrame, key: str = "url", delay: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark."""
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def dilation(scores: DataFrame) -> DataFrame:
    """``video_id, chunk, separate`` two chunks late. State holds five scores at most.

    ``scores``: video_id, chunk, score; a row with a null score ends the video and lets the last two
    chunks out. A chunk that was not there when its turn came, or whose neighbour was not, is separated;
    if it comes after its turn it still counts for those whose turn is to come. Scores are floats and are
    compared with the thresholds as floats: 0.02 as a float is below 0.02 as a double.
    """
    music, some = np.float32(MUSIC), np.float32(NEAR_MUSIC)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, last, places, held = state.get if state.exists else (0, -1, [], [])
        at, values, end = [np.array(places, np.int64)], [np.array(held, np.float32)], False
        for rows in batches:
            known = rows.score.notna().to_numpy()
            end = end or not known.all()
            known &= rows.chunk.to_numpy() >= done - 2
            at.append(rows.chunk.to_numpy()[known].astype(np.int64))
            values.append(rows.score.to_numpy()[known].astype(np.float32))
        at, values = np.concatenate(at), np.concatenate(values)
        last = max(last, int(at.max(initial=-1)))
        seen = np.full(max(0, last - done + 3), np.nan, np.float32)  # from done - 2 on; the last of equal chunks counts
        seen[at - (done - 2)] = values
        first, stop = done - 2, last if end else last - 2
        while done <= stop:
            upto = min(stop + 1, done + 500_000)
            places = np.arange(done - 2, upto + 2)
            around = np.full(len(places), -np.inf, np.float32)  # before the start and after the end is silence
            inside = (places >= 0) & (places <= last)
            around[inside] = seen[places[inside] - first]
            wide = np.lib.stride_tricks.sliding_window_view(around, 5)
            separate = np.isnan(wide).any(axis=1) | (wide[:, 1:4].max(axis=1) >= music) | ((wide[:, 2] >= some) & (wide.max(axis=1) >= music))
            yield pd.DataFrame({"video_id": key[0], "chunk": np.arange(done, upto), "separate": separate})
            done = upto
        places = np.arange(max(first, done - 2), last + 1)
        places = places[~np.isnan(seen[places - first])]
        state.update((done, last, places.tolist(), seen[places - first].tolist()))

    return scores.groupBy("video_id").applyInPandasWithState(step, "video_id string, chunk long, separate boolean", "done long, last long, places array<long>, held array<double>", "append", "NoTimeout")


def settle(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, exactly once, and read its result table."""
    spark: SparkSession = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        where = f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}"
        batch.write.mode("overwrite").parquet(where)  # a repeated batch overwrites itself

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
