"""Slot rule, transforms and interval scans over whole videos and tracks against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import dense
from spanwise.operators import sampler, spectra


def plain_slots(pts, step, start=None, end=None):
    pts = sorted({p for p in pts if p is not None and (start is None or p >= start) and (end is None or p < end)})
    out, slot = [], start if start is not None else (pts[0] if pts else 0)
    for p in pts:
        if p >= slot:
            out.append(p)
            slot = slot + step if slot + step > p else p + step
    return out


def series(rng, kind, n):
    gaps = {"dense": [33, 34], "sparse": [200, 900, 3000], "just over": [701], "step": [700], "mixed": [40, 40, 40, 699, 700, 701, 1399, 1400, 5000], "holes": [100] * 40 + [20_000]}[kind]
    pts, at = [], rng.randrange(3000)
    for _ in range(n):
        pts.append(at)
        at += rng.choice(gaps)
    return pts


@pytest.mark.parametrize("window", [1400, 4000, None])
@pytest.mark.parametrize("span", [(None, None), (1234, None), (0, 60_000), (25_000, 90_001)])
def test_slots(spark, window, span):
    rng = random.Random(3)
    videos = {k: series(rng, k, 300) for k in ("dense", "sparse", "just over", "step", "mixed", "holes")}
    rows = [(v, p) for v, pts in videos.items() for p in pts] + [("dense", videos["dense"][5]), ("mixed", None), ("late", 10_000_000)]
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "video_id string, pts_ms long")
    got = sorted((r.video_id, r.pts_ms) for r in sampler.samples(frames, 700, *span, window=window).collect())
    want = sorted((v, p) for v, pts in {**videos, "late": [10_000_000]}.items() for p in plain_slots(pts, 700, *span))
    assert got == want


def test_no_slots(spark):
    frames = spark.createDataFrame([], "video_id string, pts_ms long")
    assert sampler.samples(frames, 700).count() == 0
    with pytest.raises(ValueError):
        sampler.samples(frames, 700, window=100)


def tracks(spark, lengths):
    rng = np.random.default_rng(1)
    waves = {f"t{k}": rng.normal(size=k) for k in lengths}
    rows = [(t, i, float(x)) for t, w in waves.items() for i, x in enumerate(w)]
    random.Random(2).shuffle(rows)
    return waves, spark.createDataFrame(rows, "track_id string, i long, l double")


@pytest.mark.parametrize("n, hop, block, lengths", [(64, 16, 4, (20, 40, 41, 57, 64, 65, 200, 1000, 1023, 1024, 1025)), (4096, 1024, 3, (3000, 9000, 20_481))])
def test_spectra(spark, n, hop, block, lengths):
    waves, table = tracks(spark, lengths)
    found = spectra.spectra(table, "track_id", "l", n, hop, block).cache()
    by_track = {}
    for r in found.collect():
        by_track.setdefault(r.track_id, {})[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    for t, w in waves.items():
        whole = dense.stft(w, n, hop)
        assert sorted(by_track[t]) == list(range(whole.shape[1]))
        assert np.abs(np.stack([by_track[t][f] for f in range(whole.shape[1])], axis=1) - whole).max() < 1e-12
    sizes = spark.createDataFrame([(t, len(w)) for t, w in waves.items()], "track_id string, length long")
    back = spectra.waves(found, sizes, "track_id", n, hop, block).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
    for r in back:
        want = dense.istft(dense.stft(waves[r.track_id], n, hop), len(waves[r.track_id]), n, hop)
        got = np.array([s.x for s in r.s])
        assert [s.i for s in r.s] == list(range(len(want))) and np.abs(got - want).max() < 1e-9
