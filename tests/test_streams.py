"""Streams over files give what the batch operators give."""

import random
import time

import pandas as pd

from pyspark.sql import functions as F

from spanwise.operators import audio
from spanwise.streaming import twins


def test_dilation_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [("v", c, rng.choice([0.0, 0.01, 0.05, 0.9])) for c in range(40)]
    batch = spark.createDataFrame(rows, "video_id string, chunk long, score float")
    want = {(r.chunk, r.separate) for r in audio.dilate(batch, "video_id").collect()}
    batch.unionByName(spark.createDataFrame([("v", 40, None)], batch.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    assert {(r.chunk, r.separate) for r in twins.settle(twins.dilation(stream), str(tmp_path / "run")).collect()} == want


def test_dilation_stream_compares_floats(spark, tmp_path):
    """A score of exactly 0.02, a float, is not silent, and one of exactly 0.15 is music, as in the batch form."""
    rows = [("v", c, x) for c, x in enumerate([0.02, 0.0, 0.9, 0.0, 0.02, 0.0, 0.0, 0.02, 0.0, 0.15, 0.0, 0.019])]
    batch = spark.createDataFrame(rows, "video_id string, chunk long, score float")
    want = {(r.chunk, r.separate) for r in audio.dilate(batch, "video_id").collect()}
    batch.unionByName(spark.createDataFrame([("v", 12, None)], batch.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = {(r.chunk, r.separate) for r in twins.settle(twins.dilation(stream), str(tmp_path / "run")).collect()}
    assert got == want and {c for c, separate in got if not separate} == {5, 6, 11}


def test_dedupe_stream(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 5).cast("string").alias("url"), F.timestamp_seconds("id").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert twins.settle(twins.deduped(stream), str(tmp_path / "run")).count() == 5


def test_dilation_of_a_long_video():
    """Time and state are linear in the chunks that come at once; the last two wait for what follows."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    made = {}

    class Scores:
        def groupBy(self, by):
            return self

        def applyInPandasWithState(self, step, *kinds):
            made["step"] = step

    twins.dilation(Scores())
    rng, n, state = random.Random(2), 200_000, State()
    scores = [rng.choice([0.0, 0.01, 0.02, 0.05, 0.9]) for _ in range(n)]
    places = list(range(n))
    rng.shuffle(places)
    frames = [pd.DataFrame({"chunk": places[k : k + 10_000], "score": [scores[p] for p in places[k : k + 10_000]]}) for k in range(0, n, 10_000)]
    begun = time.time()
    first = pd.concat(made["step"](("v",), iter(frames), state))
    assert len(first) == n - 2 and len(state.get[2]) == 4
    rest = pd.concat(made["step"](("v",), iter([pd.DataFrame({"chunk": [n], "score": [None]})]), state))
    assert time.time() - begun < 20
    got = pd.concat([first, rest])
    want = [max(scores[max(0, k - 1) : k + 2]) >= 0.15 or (scores[k] >= 0.02 and max(scores[max(0, k - 2) : k + 3]) >= 0.15) for k in range(n)]
    assert got.chunk.tolist() == list(range(n)) and got.separate.tolist() == want
