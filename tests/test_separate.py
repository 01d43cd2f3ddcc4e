"""The separator as a stream against the batch form, and its gate against the batch rule."""

import random

import numpy as np
from test_live import DAY, at, dropped, seen_total

from spanwise.operators import audio
from spanwise.streaming import append, separate

SEGMENT, STRIDE, LEAD = 60, 50, 11


def blocks_of(rng, tracks):
    """Samples of each track, and its blocks with a score each."""
    waves, rows = {}, []
    for t, n in tracks.items():
        wave = np.array([[rng.uniform(-1.2, 1.2), rng.uniform(-0.5, 0.5)] for _ in range(n)])
        waves[t] = wave
        mono = wave.mean(axis=1)
        mean, std = float(mono.mean()), max(1e-8, float(mono.std(ddof=1)) if n > 1 else 0.0)
        for b in range(-(-(n + LEAD) // STRIDE)):
            part = wave[max(0, b * STRIDE - LEAD) : (b + 1) * STRIDE - LEAD]
            rows.append((t, at(b * 100, DAY), b, rng.choice([0.0, 0.01, 0.05, 0.4]), part[:, 0].tolist(), part[:, 1].tolist(), n, mean, std))
    return waves, rows


SCHEMA = "track_id string, ts timestamp, block long, score double, l array<double>, r array<double>, n long, mean double, std double"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    tracks = {"a": 900, "b": 39, "c": 40, "d": 5, "e": 489, "f": 441}
    waves, rows = blocks_of(rng, tracks)
    beat = ("~", at(10_000_000, DAY), 0, 0.0, [], [], 1, 0.0, 1.0)
    cut = at(900, DAY)
    parts = [[r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut] + [beat]]
    rng.shuffle(parts[0])
    out, progress = append.delivered([spark.createDataFrame(p, SCHEMA).repartition(2) for p in parts], lambda s: separate.separated(s, lambda w: w, SEGMENT, STRIDE, LEAD, origin=DAY), str(tmp_path / "same"))
    samples = spark.createDataFrame([(t, i, float(x), float(y)) for t, w in waves.items() for i, (x, y) in enumerate(w)], "track_id string, i long, l double, r double")
    want = {(r.track_id, r.i): (r.l, r.r) for r in audio.separate(samples, "track_id", lambda w: w, SEGMENT, STRIDE, LEAD).collect()}
    got = {(r.track_id, r.i): (r.l, r.r) for r in out.collect()}
    assert got.keys() == want.keys() and out.count() == len(want)
    assert max(abs(g - w) for k in want for g, w in zip(got[k], want[k])) < 1e-9
    assert dropped(progress) == 0 and seen_total(progress)[-1] <= 4 * (len(tracks) + 1)


def test_gate_and_missing_blocks():
    """Decisions equal the batch rule; where a neighbour's score is not there, the chunk is separated."""
    machine = separate.Separator(lambda w: w, SEGMENT, STRIDE, LEAD, 0)
    rng = random.Random(2)
    for _ in range(200):
        last = rng.randrange(12)
        scores = {k: rng.choice([0.0, 0.01, 0.019, 0.02, 0.05, 0.149, 0.15, 0.4]) for k in range(last + 1)}
        for k in range(last + 1):
            near = max(scores.get(j, 0.0) for j in (k - 1, k, k + 1))
            far = max(scores.get(j, 0.0) for j in range(k - 2, k + 3))
            assert machine._separate(k, last, scores) == (near >= 0.15 or (scores[k] >= 0.02 and far >= 0.15))
            gone = {j: s for j, s in scores.items() if j != k - 1}
            assert k == 0 or machine._separate(k, last, gone)
