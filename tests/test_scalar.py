"""Vectors of the scalar rules and dense kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import dense
from spanwise.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("a", "b"), [("1.1", "1.2"), ("1.9", "1.10"), ("1.2", "1.2.1"), ("1.2-beta2", "v1.2"), ("1.2-beta1", "1.2-beta2"), ("1.2-beta2", "1.2-beta10"), ("1.1", "1.2-beta1"), ("1.2-alpha9", "1.2-beta1")])
def test_version_order(spark, a, b):
    assert one(spark, S.version(F.lit(a)) < S.version(F.lit(b)))


def test_version_edges(spark):
    assert one(spark, S.version(F.lit("1.2")) == S.version(F.lit("1.2.0")))
    assert one(spark, S.version(F.lit("latest"))) is None and one(spark, S.version(F.lit(""))) is None


@pytest.mark.parametrize(("raw", "want"), [(" Women ", "women"), (None, None), ("", None), ("   ", None), ("true", "everyone"), ("female", "everyone"), ("none", "none")])
def test_who(spark, raw, want):
    assert one(spark, S.who(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("d", "want"), [(0, (0, 0, 0.2, 0.4)), (90, (0, 0.8, 0.4, 1)), (180, (0.8, 0.6, 1, 1)), (270, (0.6, 0, 1, 0.2)), (-270, (0, 0.8, 0.4, 1)), (450, (0, 0.8, 0.4, 1))])
def test_rotation(spark, d, want):
    assert tuple(one(spark, S.rotated(F.lit(0.0), F.lit(0.0), F.lit(0.2), F.lit(0.4), F.lit(d)))) == pytest.approx(want)


def test_yuv_and_colour(spark):
    assert tuple(one(spark, S.yuv_rgb(F.lit(81), F.lit(90), F.lit(240)))) == (238, 15, 13)
    assert tuple(one(spark, S.argb(F.lit(-65536)))) == (255, 0, 0) and one(spark, S.argb(F.lit(0))) is None


@pytest.mark.parametrize(
    ("text", "io", "want"),
    [("ENOSPC while writing", True, "OUT_OF_SPACE"), ("crypto error", True, "DRM"), ("decoder gone", True, "UNSUPPORTED_CODEC"), ("Failed to initialize audio/ac3", False, "UNSUPPORTED_CODEC"), ("odd", True, "UNREADABLE"), ("odd", False, "GENERIC"), (None, False, "GENERIC")],
)
def test_errors(spark, text, io, want):
    assert one(spark, S.filter_error(F.lit(text).cast("string"), F.lit(io))) == want


def test_small_rules(spark):
    assert one(spark, S.eta_ms(F.lit(193_000), F.lit(True), F.lit(False))) == 54040
    assert one(spark, S.eta_ms(F.lit(0), F.lit(True), F.lit(True))) == 0
    assert one(spark, S.first_url(F.lit("see https://a.b/c, ok"))) == "https://a.b/c"
    assert one(spark, S.host(F.lit("https://www.x.org/y"))) == "x.org"
    assert [tuple(x) for x in one(spark, S.span_list(F.lit("1-5,x,7 - 9,3")))] == [(1, 5), (7, 9)]
    assert one(spark, S.quantized(F.lit(float("nan")))) == 0 and one(spark, S.quantized(F.lit(2.0))) == 32767
    w = one(spark, S.gaussian(F.lit(2.0), F.lit(4)))
    assert w[0] + 2 * sum(w[1:]) == pytest.approx(1)


def test_stft():
    assert [dense.frames_of(n, 1024)[0] for n in (343980, 335 * 1024, 335 * 1024 + 1, 336 * 1024 + 1)] == [336, 335, 336, 337]
    z = dense.stft(np.random.default_rng(7).normal(size=4123), 64, 16)
    assert z.shape == (32, 258)
    t = np.arange(8000)
    x = sum(np.sin(t * f + f) for f in np.linspace(0.05, 1.0, 20)) / 40
    error = (dense.istft(dense.stft(x, 256, 64), len(x), 256, 64) - x)[512:-512]  # the outermost frames are dropped by rule
    assert 10 * np.log10((x[512:-512] ** 2).sum() / (error**2).sum()) > 60


def test_pixels():
    p = np.array([[10, 20], [30, 40]])
    assert [dense.upright(p, d).ravel().tolist() for d in (90, 180, 270)] == [[30, 10, 40, 20], [40, 30, 20, 10], [20, 40, 10, 30]]
    flat = np.full((2, 2), 81), np.array([[90]]), np.array([[240]])
    assert dense.rgb(*flat)[:, 0, 0].tolist() == [238, 15, 13]
    assert dense.nv21(np.arange(16).reshape(4, 4), np.full((2, 2), 1), np.full((2, 2), 2), 2, 2).tolist() == [0, 2, 8, 10, 2, 1]
