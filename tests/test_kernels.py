"""Dense kernels, models and required rows against definitions written out in loops."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import dense, models
from spanwise.functions import scalar as S
from spanwise.operators import audio, intervals, numbering


def reflected(x, left, right):
    n = len(x)
    return [x[-i] if i < 0 else x[2 * (n - 1) - i] if i >= n else x[i] for i in range(-left, n + right)]


@pytest.mark.parametrize("length", [40, 64, 77])
def test_transform_by_its_definition(length):
    n, hop = 16, 4
    x = [math.sin(0.3 * i) + 0.2 * math.cos(1.1 * i) for i in range(length)]
    le = -(-length // hop)
    pad = hop // 2 * 3
    wide = reflected(reflected(x, pad, pad + le * hop - length), n // 2, n // 2)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / n) for k in range(n)]
    want = np.array([[sum(wide[(f + 2) * hop + k] * window[k] * cmath.exp(-2j * math.pi * b * k / n) for k in range(n)) / math.sqrt(n) for f in range(le)] for b in range(n // 2)])
    got = dense.stft(np.array(x), n, hop)
    assert got.shape == (n // 2, le) and np.allclose(got, want)


def test_inverse_transform_of_a_slow_sound():
    x = np.sin(np.arange(4000) * 0.05)
    assert np.abs(dense.istft(dense.stft(x, 64, 16), len(x), 64, 16) - x)[200:-200].max() < 1e-3


def test_colours_and_turns_pixel_by_pixel():
    rng = np.random.default_rng(3)
    y, u, v = rng.integers(0, 256, (4, 6)), rng.integers(0, 256, (2, 3)), rng.integers(0, 256, (2, 3))
    got = dense.rgb(y, u, v)
    for r in range(4):
        for c in range(6):
            a, b = int(u[r // 2, c // 2]) - 128, int(v[r // 2, c // 2]) - 128
            want = [int(y[r, c]) + (1436 * b >> 10), int(y[r, c]) - (352 * a + 731 * b >> 10), int(y[r, c]) + (1815 * a >> 10)]
            assert got[:, r, c].tolist() == [max(0, min(255, w)) for w in want]
    turned = dense.tensor(y, u, v, 90)
    assert turned.shape == (1, 3, 6, 4) and turned.dtype == np.float32
    assert all(turned[0, k, c, 3 - r] == np.float32(got[k, r, c]) / 255 for k in range(3) for r in range(4) for c in range(6))


def test_square_crop_pixel_by_pixel():
    picture = np.arange(3 * 20 * 30).reshape(3, 20, 30)
    left, top, right, bottom, side = 0.1, 0.2, 0.3, 0.7, 8
    got = dense.square_crop(picture, left, top, right, bottom, side)
    half = max((right - left) * 30, (bottom - top) * 20) * 0.75
    for i in range(side):
        for j in range(side):
            x = min(29, max(0, int((left + right) / 2 * 30 - half + j * half * 2 / side)))
            y = min(19, max(0, int((top + bottom) / 2 * 20 - half + i * half * 2 / side)))
            assert got[:, i, j].tolist() == picture[:, y, x].tolist()


def test_required_rows(spark):
    some = spark.createDataFrame([(1, None)], "id int, first int")
    with pytest.raises(Exception, match="no video track"):
        some.select(S.required(F.col("first"), "no video track")).collect()


def test_a_model_is_made_once_and_may_fail(spark):
    def factory():
        return lambda x: float(x.sum())

    assert models.session(factory) is models.session(factory)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, x array<double>")
    assert {r.id: r.s for r in df.select("id", models.per_row(factory, "double")("x").alias("s")).collect()} == {1: 3.0, 2: None}


def test_next_mark(spark):
    points = spark.createDataFrame([(v, t) for v in ("a", "b", "c") for t in (0, 5, 10, 11, 25, 1000)], "v string, t long")
    marks = spark.createDataFrame([("a", 10), ("a", 24), ("b", 999), ("a", 990)], "v string, t long")
    have = {"a": [10, 24, 990], "b": [999], "c": []}
    got = {(r.v, r.t): r.next for r in intervals.next_at(points, marks, ["v"], bucket=7).collect()}
    assert got == {(v, t): min([m for m in have[v] if m >= t], default=None) for v in have for t in (0, 5, 10, 11, 25, 1000)}


def test_numbers_and_changes_across_buckets(spark):
    rows = [(g, i, i % 37 // 5 if g else 1) for g in (0, 1, None) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i long, v int")
    got = numbering.numbered(df, ["g"], F.floor(F.col("i") / 16), ["i"], "n").collect()
    assert len(got) == 600 and all(r.n == r.i for r in got)
    turns = {(r.g, r.i) for r in numbering.changes(df, ["g"], F.floor(F.col("i") / 16), ["i"], "v").collect()}
    assert turns == {(g, i) for g, i, v in rows if i == 0 or v != (rows[[0, 1, None].index(g) * 200 + i - 1][2])}


def test_resumed_chunks_equal_the_full_run(spark):
    wave = spark.range(5000).selectExpr("'t' AS track", "id AS i", "sin(id * 0.01) AS l", "cos(id * 0.02) / 2 AS r")

    def model(x):  # not the identity: what it gives depends on the whole chunk
        return x * 0.5 + x[::-1] * 0.01

    full = {r.i: (r.l, r.r) for r in audio.separate(wave, "track", model, 600, 540, 110).collect()}
    done = spark.createDataFrame([("t", 2345)], "track string, written long")
    rest = {r.i: (r.l, r.r) for r in audio.separate(wave, "track", model, 600, 540, 110, done).collect()}
    assert sorted(full) == list(range(5000)) and rest == {i: x for i, x in full.items() if i >= 2345}


def test_gaps_force_separation(spark):
    rows = [("v", c, 0.0) for c in range(12) if c != 5] + [("w", c, 0.0) for c in range(5)]
    got = {(r.video_id, r.chunk) for r in audio.dilate(spark.createDataFrame(rows, "video_id string, chunk long, score float"), "video_id").where("separate").collect()}
    assert got == {("v", c) for c in (3, 4, 6, 7)}
