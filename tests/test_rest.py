"""Small rules by hand and against numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import scalar
from spanwise.operators import audio, gate, planning
from spanwise.sources import checkpoints

CLASSES = list(gate.THRESHOLDS)


def numpy_fires(scores, strictness):
    """The gate once more, on an array of (frames, 5) 32-bit scores."""
    low, high, bad = (np.array([gate.THRESHOLDS[c][k] for c in CLASSES], dtype) for k, dtype in ((0, np.float32), (1, np.float32), (2, bool)))
    share = (high - low) * np.float32(min(100, max(0, strictness))) / np.float32(100)
    margin = scores - (low + share)
    return (margin[:, bad].max(axis=1) >= 0) & (margin[:, bad].max(axis=1) > margin[:, ~bad].max(axis=1))


def numpy_intervals(pts, duration):
    """Hysteresis of firing times by gaps: a new interval where the clamped ends do not touch."""
    if not len(pts):
        return []
    pts = np.sort(pts)
    begin, end = np.maximum(0, pts - 500), np.minimum(duration, pts + 1500)
    cut = np.flatnonzero(begin[1:] > end[:-1] + 1) + 1
    starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(pts)]])
    return list(zip(begin[starts].tolist(), end[stops - 1].tolist()))


@pytest.mark.parametrize("strictness", [-5, 0, 40, 77, 100, 300])
def test_second_gate(spark, strictness):
    rng = np.random.default_rng(strictness + 10)
    scores = rng.dirichlet(np.ones(5), 400).astype(np.float32)
    pts = np.sort(rng.choice(200_000, 400, replace=False))
    table = spark.createDataFrame([("v", int(p), *map(float, s)) for p, s in zip(pts, scores)], "video_id string, pts_ms long, " + ", ".join(f"{c} float" for c in CLASSES))
    fired = gate.firings(table, strictness)
    want = pts[numpy_fires(scores, strictness)]
    assert sorted(r.pts_ms for r in fired.collect()) == want.tolist()
    spans = gate.hysteresis(fired, spark.createDataFrame([("v", 198_000)], "video_id string, duration_ms long"))
    assert sorted((r.s, r.e) for r in spans.collect()) == numpy_intervals(want, 198_000)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 127, 128, 150, 192])
def test_window_frames(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([("w", j, float(v)) for j, v in enumerate(x)], "w string, j long, x double")
    starts, at = [], 0
    while True:
        starts.append(at)
        if at + 64 >= n:
            break
        at = min(at + 64, n - 64)
    got = audio.window_scores(rows, ["w"], 64).first()
    assert got.frames == len(starts) and got.score == pytest.approx(max(np.abs(x[s : s + 64]).sum() / 64 for s in starts))
    quiet = rows.withColumn("x", F.col("x") * 1e-5)
    assert audio.window_scores(quiet, ["w"], 64).first().score == 0.0


def test_silence_by_peak_not_score(spark):
    """One loud sample in a quiet window: the score is small, but the window is not silent."""
    rows = spark.createDataFrame([("w", j, 0.0011 if j == 7 else 0.0) for j in range(64)], "w string, j long, x double")
    assert 0 < audio.window_scores(rows, ["w"], 64).first().score < 0.001


def test_keys_count_utf16_units(spark):
    import hashlib

    texts = ["plain", "é", "\U0001f600", "a\U0001f600\U0010ffff", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.content_key(F.col("t")).alias("k")).collect()
    text = lambda t: "null" if t is None else t
    assert [r.k for r in got] == [hashlib.sha256(f"{len(text(t).encode('utf-16-le')) // 2}:{text(t)}|".encode()).hexdigest()[:16] for t in texts]


def test_took_text(spark):
    rows = spark.createDataFrame([(0,), (2999,), (15_000,), (60_000,), (90_061,)], "ms long").select(scalar.took_text(F.col("ms")).alias("t")).collect()
    assert [r.t for r in rows] == ["0ms(0.0min)", "2999ms(0.0min)", "15000ms(0.3min)", "60000ms(1.0min)", "90061ms(1.5min)"]


def test_eval_frames_end_with_the_segment(spark):
    plan = spark.createDataFrame([(1, 0, 0, 300_000), (1, 1, 300_000, 307_300), (1, 2, 307_300, 307_500)], "video_id long, idx long, start_ms long, end_ms long")
    got = planning.eval_frames(plan).groupBy("idx", "use").count().collect()
    assert {(r.idx, r.use): r["count"] for r in got} == {(0, "eval"): 36, (0, "calib"): 10, (1, "eval"): 36, (1, "calib"): 1, (2, "eval"): 1}


def test_eval_totals_make_no_frames(spark):
    """The sums of each video and use are those of its frames, for every length at which a frame more fits, and no row per frame is made."""
    lengths = [1, 199, 200, 201, 7000, 7001, 7199, 7200, 7201, 11_200, 11_201, 39_201, 43_199, 43_200, 43_201, 300_000]
    plan = spark.createDataFrame([(v, i, s, s + n) for v in range(4) for i, n in enumerate(lengths) if i % 4 >= v for s in [v + i * 300_000]] + [(9, 0, 5, 6)], "video_id long, idx long, start_ms long, end_ms long")
    sums = planning.eval_frames(plan).groupBy("video_id", "use").agg(F.count("*").alias("n"), F.sum(F.col("pts_ms") * (F.col("k") + 1)).alias("placed"), F.min("pts_ms").alias("first_ms"), F.max("pts_ms").alias("last_ms"))
    got = planning.eval_totals(plan)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sums.collect())) and got.where("video_id = 9").count() == 1
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate") == 1 and text.index("Generate") < text.index("Aggregate")  # the uses, behind the sums


def test_checkpoint_documents(spark, tmp_path):
    folder, good = str(tmp_path / "docs"), '{"startMs":0,"endMs":300,"events":[{"s":1,"e":2}]}'
    bodies = [(1, 0, good), (1, 1, good[:-3]), (1, 2, ""), (1, 3, '{"startMs":0,"events":[]}'), (1, 4, '{"startMs":900,"endMs":1200,"events":[]}'), (2, 0, good)]
    checkpoints.write(spark.createDataFrame(bodies, "video_id long, idx long, body string"), folder)
    checkpoints.write(spark.createDataFrame([(1, 0, good)], "video_id long, idx long, body string"), folder)  # again: replaced, not added
    plan = spark.createDataFrame([(v, i, i * 300 if v == 1 and i else 0, (i + 1) * 300) for v in (1, 2) for i in range(6)], "video_id long, idx long, start_ms long, end_ms long")
    rows = {(r.video_id, r.idx): r for r in checkpoints.state(plan, checkpoints.read(spark, folder)).collect()}
    assert {k[1]: r.state for k, r in rows.items() if k[0] == 1} == {0: "done", 1: "corrupt", 2: "corrupt", 3: "corrupt", 4: "other", 5: "missing"}
    assert [rows[2, i].state for i in range(6)] == ["done"] + ["missing"] * 5
    assert rows[1, 0].bytes >= len(good) and rows[1, 0].document.events[0].e == 2 and rows[1, 5].bytes is None
    second = tmp_path / "docs" / "video_id=2" / "idx=0"
    (second / "another.txt").write_text(good)  # two documents of one key
    rows = {(r.video_id, r.idx): r.state for r in checkpoints.state(plan, checkpoints.read(spark, folder)).collect()}
    assert rows[2, 0] == "corrupt"


def test_many_checkpoint_documents(spark, tmp_path):
    """Thousands of folders: tasks write and read them, not the driver one by one; two bodies of one key are both kept and count as broken."""
    folder, good = str(tmp_path / "docs"), '{"startMs":0,"endMs":300,"events":[]}'
    many = spark.range(4000).select(F.col("id").alias("video_id"), F.lit(0).cast("long").alias("idx"), F.lit(good).alias("body"))
    begun = time.time()
    checkpoints.write(many.unionByName(many.where("video_id = 7")), folder)
    found = checkpoints.read(spark, folder)
    assert found.count() == 4000 and found.where("document is null").select("video_id").collect() == [(7,)]
    assert time.time() - begun < 45
    checkpoints.write(many.where("video_id = 7"), folder)
    assert found.where("document is null").count() == 0 and not list((tmp_path / "docs" / "_drafts").iterdir())


def test_stale_by_newest_file_or_own_time(spark):
    rows = [("new file", "2024-05-01", "2020-01-01"), ("old file", "2020-05-01", "2024-05-01"), ("no file", None, "2020-01-01"), ("no file, new", None, "2024-05-01"), ("no time", None, None)]
    table = spark.createDataFrame(rows, "name string, changed string, made string").select("name", F.col("changed").cast("timestamp").alias("changed"), F.col("made").cast("timestamp").alias("made"))
    got = checkpoints.stale(table, F.lit("2024-05-02").cast("timestamp"), 7 * 86_400_000).collect()
    assert {r.name: r.stale for r in got} == {"new file": False, "old file": True, "no file": True, "no file, new": False, "no time": False}


def test_tracks_are_dealt_before_the_grid(spark):
    """A table of tracks that is one partition makes the chunks of its tracks in several tasks."""
    tracks = spark.createDataFrame([(i, 1_000_000 + i) for i in range(100)], "track_id long, frames long").coalesce(1)
    parts = audio.chunk_grid(tracks).select("track_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in parts}) > 1 and len(parts) == 100


def test_grid_by_lots_is_small_on_disk(spark, tmp_path):
    """The same rows as the grid, those of tracks shorter than the others of their lot too, in under half the bytes."""
    tracks = spark.range(800).select(F.col("id").alias("track_id"), (F.col("id") * 99_991 % 120_000_000 + F.when(F.col("id") % 50 == 0, 0).otherwise(50_000_000)).alias("frames"))
    sizes, sums = [], []
    for name, grid in (("tracks", audio.chunk_grid), ("lots", audio.chunk_grid_by_lots)):
        out = str(tmp_path / name)
        grid(tracks).write.parquet(out)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")))
        sums.append(spark.read.parquet(out).agg(F.count("*"), F.countDistinct("track_id"), F.sum(F.xxhash64("track_id", "chunk", "off", "n").cast("decimal(38,0)"))).first())
    assert sums[0] == sums[1] and sums[0][1] == 799 and sizes[1] * 2 < sizes[0], sizes


def test_grid_by_lots_of_one_length(spark):
    """Many tracks of one length are many lots, and odd ones (no frames, none known, one chunk) keep their rows."""
    tracks = spark.range(300).select(F.col("id").alias("track_id"), F.lit(200_000).cast("long").alias("frames")).unionByName(spark.createDataFrame([(300, 0), (301, None), (302, 1), (302, 1)], "track_id long, frames long"))
    rows = lambda grid: sorted(map(tuple, grid.collect()))
    assert rows(audio.chunk_grid_by_lots(tracks, 8)) == rows(audio.chunk_grid(tracks))
