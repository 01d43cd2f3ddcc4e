"""Queries over whole tables against brute force; none leaves a share of the rows out."""

import datetime
import random

import pytest

from spanwise.operators import audio
from spanwise.plans import catalogue, more  # noqa: F401  (more registers its queries)

QUERIES = catalogue.QUERIES


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng, d = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    start = datetime.datetime(2024, 1, 1)
    events = [(i, rng.choice("ab"), rng.randrange(9), rng.randrange(700_000), rng.choice([0.0, 0.25, 0.5, 100.0]), rng.randrange(100)) for i in range(400)]
    rows = [(i, start + datetime.timedelta(seconds=t), u, v, x, f'{{"k": {k}}}') for i, v, u, t, x, k in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    orders = [(i, i % 7, rng.choice("FPO"), rng.randrange(1, 100_000) / 100, start) for i in range(60)] + [(60, 1, "F", 0.0, start)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    return d, events, orders


def test_chunk_grid_all(spark, made):
    d, _, orders = made
    want = []
    for key, _, _, price, _ in orders:
        frames, chunk = int(price * 20) * 441 // 10, 0
        while frames > 0 and chunk * audio.STRIDE - audio.LEAD < frames:
            off = chunk * audio.STRIDE - audio.LEAD
            want.append((key, chunk, off, min(off + audio.SEGMENT, frames) - max(off, 0)))
            chunk += 1
    got = sorted((r.track_id, r.chunk, r.off, r.n) for r in QUERIES["chunk_grid_all"](spark, d).collect())
    assert got == sorted(want) and len({r[0] for r in got}) == 60


def test_interval_bridge_merge_all(spark, made):
    d, events, _ = made
    want = []
    for v in "ab":
        spans = sorted((t, t + k) for _, x, _, t, _, k in events if x == v)
        out = [list(spans[0])]
        for s, e in spans[1:]:
            if s > out[-1][1] + 400:
                out.append([s, e])
            else:
                out[-1][1] = max(out[-1][1], e)
        want += [(v, s, e) for s, e in out]
    assert sorted((r.video_id, r.s, r.e) for r in QUERIES["interval_bridge_merge_all"](spark, d).collect()) == sorted(want)


def test_slot_sampler_all(spark, made):
    d, events, _ = made
    want = []
    for v in "ab":
        for w in range(3):
            slot = w * 300_000
            for t in sorted({t for _, x, _, t, _, _ in events if x == v and t // 300_000 == w}):
                if t >= slot:
                    want.append((v, t))
                    slot = t + 700 if slot + 700 <= t else slot + 700
    assert sorted((r.video_id, r.pts_ms) for r in QUERIES["slot_sampler_all"](spark, d).collect()) == sorted(want)


def test_silence_floor_all(spark, made):
    d, events, _ = made
    want = []
    for v in "ab":
        for n, (_, _, x) in enumerate(sorted((t, i, x) for i, y, _, t, x, _ in events if y == v)):
            want.append((v, n, 0.0 if x / 500 < 0.001 else round(x / 500, 6)))
    assert sorted((r.video_id, r.chunk, round(r.floored, 6)) for r in QUERIES["silence_floor_all"](spark, d).collect()) == sorted(want)
