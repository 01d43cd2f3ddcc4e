"""Vectors of the gate, interval and track rules, and random comparison with plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from spanwise.operators import audio, gate, intervals, planning, tracks

NAMES = ("drawings", "hentai", "neutral", "porn", "sexy")


@pytest.mark.parametrize(
    ("s", "expected"),
    [(0, (0.50, 1.00, 0.30, 0.75, 0.90)), (100, (0.50, 0.50, 1.00, 0.10, 0.10)), (50, (0.50, 0.75, 0.65, 0.425, 0.50)), (-20, (0.50, 1.00, 0.30, 0.75, 0.90)), (200, (0.50, 0.50, 1.00, 0.10, 0.10))],
)
def test_thresholds(spark, s, expected):
    row = spark.range(1).select(*[gate.threshold(n, F.lit(s)).cast("double") for n in NAMES]).first()
    assert tuple(row) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(
    ("p", "s", "fires"),
    [((0.1, 0.1, 0.1, 0.6, 0.1), 50, True), ((0, 0, 0.1, 0, 0.85), 50, True), ((0, 0, 0.55, 0.8, 0), 0, False), ((0, 0, 0.55, 0.8, 0), 100, True), ((0.05, 0, 0.9, 0.05, 0), 50, False), ((0, 0.9, 0.05, 0, 0), 0, False), ((0, 0.9, 0.05, 0, 0), 100, True)],
)
def test_fires(spark, p, s, fires):
    df = spark.createDataFrame([tuple(map(float, p))], ", ".join(f"{n} float" for n in NAMES))
    assert df.select(gate.fires(F.lit(s))).first()[0] is fires


@pytest.mark.parametrize(
    ("fired", "expected"),
    [([], []), ([1000, 1500], [(500, 3000)]), ([1000, 3001], [(500, 4501)]), ([1000, 3002], [(500, 2500), (2502, 4502)]), ([1500, 1000], [(500, 3000)]), ([200], [(0, 1700)]), ([9800], [(9300, 10000)])],
)
def test_hysteresis(spark, fired, expected):
    f = spark.createDataFrame([("v", t) for t in fired], "video_id string, pts_ms long")
    d = spark.createDataFrame([("v", 10000)], "video_id string, duration_ms long")
    assert sorted((r.s, r.e) for r in gate.hysteresis(f, d).collect()) == expected


def _merge(spans, bridge):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + bridge:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize(
    ("spans", "bridge", "expected"),
    [([(9000, 9500), (1000, 2500), (0, 1500)], 0, [(0, 2500), (9000, 9500)]), ([(0, 100), (500, 600)], 400, [(0, 600)]), ([(0, 100), (501, 600)], 400, [(0, 100), (501, 600)]), ([(0, 1000), (100, 200)], 0, [(0, 1000)])],
)
def test_bridge(spark, spans, bridge, expected):
    df = spark.createDataFrame([("v", *x) for x in spans], "video_id string, s long, e long")
    assert sorted((r.s, r.e) for r in intervals.merge(df, bridge, ["video_id"]).collect()) == expected


def test_merge_and_overlap_random(spark):
    rng = random.Random(3)
    groups = {g: [(s := rng.randrange(3000), s + rng.randrange(200)) for _ in range(rng.randrange(1, 60))] for g in range(12)}
    df = spark.createDataFrame([(g, *x) for g, xs in groups.items() for x in xs], "video_id int, s long, e long")
    got = {}
    for r in intervals.merge(df, 7, ["video_id"], bucket=100).collect():
        got.setdefault(r.video_id, []).append((r.s, r.e))
    assert {g: sorted(v) for g, v in got.items()} == {g: _merge(x, 7) for g, x in groups.items()}
    hot = {}
    for r in intervals.overlaps(df, 3, ["video_id"], bucket=100).collect():
        hot.setdefault(r.video_id, []).append((r.s, r.e))
    for g, xs in groups.items():
        at = [t for t in range(3300) if sum(s <= t <= e for s, e in xs) > 3]
        runs = _merge([(t, t) for t in at], 1)
        assert sorted(hot.get(g, [])) == runs


def test_overlap_vector(spark):
    df = spark.createDataFrame([("v", 0, 100)] * 9 + [("v", 101, 200)], "video_id string, s long, e long")
    assert [(r.s, r.e) for r in intervals.overlaps(df, 8, ["video_id"]).collect()] == [(0, 100)]


def test_points_and_recall(spark):
    iv = spark.createDataFrame([("v", 1000, 2000)], "video_id string, s long, e long")
    pts = spark.createDataFrame([("v", t) for t in (999, 1000, 1500, 2000, 2001)], "video_id string, pts_ms long")
    inside = intervals.points_in(pts, iv, ["video_id"], "pts_ms", "left_semi", 300)
    assert sorted(r.pts_ms for r in inside.collect()) == [1000, 1500, 2000]
    other = spark.createDataFrame([("v", 0, 1200), ("v", 1900, 5000)], "video_id string, s long, e long")
    assert sorted((r.s, r.e) for r in intervals.intersections(iv, other, ["video_id"], 100).collect()) == [(1000, 1200), (1900, 2000)]


def test_track_rules(spark):
    rng = random.Random(5)
    rows = [(i, "v", rng.randrange(200) * 50, rng.choice([None, 1, 2, 3]), rng.randrange(60, 200), rng.choice([-1, 0, 1])) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, video_id string, pts_ms long, tracking_id int, px int, vote int")
    got = {r.event_id: r.track_key for r in tracks.sessions(df).collect()}
    live, last, n, want = {}, {}, {}, {}
    frames = sorted({r[2] for r in rows})
    for t in frames:
        for i, _, _, key, *_ in sorted(r for r in rows if r[2] == t):
            if key is None:
                want[i] = f"one:{i}"
                continue
            if key not in live:
                n[key] = n.get(key, 0) + 1
                live[key] = True
            last[key] = t
            want[i] = f"id:{key}:{n[key]}"
        for key in [k for k in live if t - last[k] >= 2000]:
            del live[key]
    assert got == want


@pytest.mark.parametrize(("f", "m", "w", "want"), [(0, 0, "women", True), (2, 2, "men", True), (4, 1, "women", True), (1, 4, "women", False), (1, 4, "men", True), (4, 1, "men", False), (9, 0, "none", False), (0, 9, "everyone", True), (0, 9, "odd", True)])
def test_verdict(spark, f, m, w, want):
    assert spark.range(1).select(tracks.should_censor(F.lit(f), F.lit(m), F.lit(w))).first()[0] is want


@pytest.mark.parametrize(("scores", "want"), [([0, 0.05, 0, 0.9, 0, 0.001, 0], {1, 2, 3, 4}), ([0, 0.05, 0, 0.9, 0, 0.03, 0], {1, 2, 3, 4, 5})])
def test_dilation(spark, scores, want):
    df = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate(scores)], "video_id string, chunk long, score float")
    for bucket in (2, 3, 4096):
        assert {r.chunk for r in audio.dilate(df, "video_id", bucket).where("separate").collect()} == want


@pytest.mark.parametrize(("ms", "snap", "forced", "n"), [(3_600_000, 0, 0, 12), (1_740_000, 0, 0, 0), (193_000, 41, 60_000, 4)])
def test_segment_plan(spark, ms, snap, forced, n):
    rows = sorted((r.idx, r.start_ms, r.end_ms) for r in planning.segment_plan(spark.createDataFrame([("v", ms)], "video_id string, duration_ms long"), lambda t: t + snap, forced).collect())
    assert len(rows) == n
    if rows:
        assert rows[0][1] == 0 and rows[-1][2] == ms
        assert all(a[2] == b[1] and a[1] < a[2] for a, b in zip(rows, rows[1:]))


def test_segment_plan_collapses(spark):
    rows = planning.segment_plan(spark.createDataFrame([("v", 7_200_000)], "video_id string, duration_ms long"), lambda t: t * 0 + 2_400_000).collect()
    assert sorted((r.start_ms, r.end_ms) for r in rows) == [(0, 2_400_000), (2_400_000, 7_200_000)]


def test_snapped_plan_against_brute_force(spark):
    rng, size = random.Random(12), planning.SEGMENT_MS
    ends = {i: rng.choice([size * rng.randrange(6, 14), rng.randrange(1_800_000, 5_000_000)]) for i in range(40)}
    videos = [*ends.items(), (40, 1_799_999), (41, size), (42, None), (43, 1_800_000), (43, 3_000_001), (44, 2_000_000), (44, 2_000_000), (None, 2_400_000)]
    keys = [(i, rng.choice([rng.randrange(6_000_000), size * rng.randrange(20)])) for i in range(46) for _ in range(rng.choice([0, 1, 5, 60]))]
    keys += [(3, ends[3]), (3, ends[3] - 1), (3, -5), (4, None), (5, size), (5, size), (5, size - 1), (43, 1_800_000), (None, 700_000)]
    cuts = {}
    for v, end in videos:
        if end is not None and end >= planning.CONFIRM_MS:
            have = [t for k, t in keys if k is not None and k == v and t is not None]
            cuts.setdefault(v, set()).update([0, end, *(min([t for t in have if t >= at] + [end]) for at in range(size, end, size))])
    want = {(v, i, a, b) for v, c in cuts.items() for i, (a, b) in enumerate(zip(sorted(c), sorted(c)[1:]))}
    got = planning.snapped_plan(spark.createDataFrame(videos, "video_id long, duration_ms long"), spark.createDataFrame(keys, "video_id long, t long")).collect()
    assert {(r.video_id, r.idx, r.start_ms, r.end_ms) for r in got} == want and len(got) == len(want)


def test_snapped_plan_beyond_32_bits(spark):
    videos, keys = spark.createDataFrame([(1, 90_000_000_000)], "video_id long, duration_ms long"), spark.createDataFrame([(1, 700_000), (1, 80_000_000_000)], "video_id long, t long")
    got = planning.snapped_plan(videos, keys).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 700_000), (1, 1, 700_000, 80_000_000_000), (1, 2, 80_000_000_000, 90_000_000_000)]


def test_snapped_plan_shuffles_no_row_per_cut(spark, capsys):
    videos, keys = spark.createDataFrame([(1, 9_000_000)], "video_id long, duration_ms long"), spark.createDataFrame([(1, 700_000), (1, 8_000_000)], "video_id long, t long")
    planning.snapped_plan(videos, keys).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 2 and "Generate" not in plan and "Join" not in plan


def test_slots(spark):
    rng = random.Random(8)
    pts = sorted({rng.randrange(20_000) for _ in range(300)})
    got = sorted(r.pts_ms for r in planning.slot_samples(spark.createDataFrame([("v", t) for t in pts], "video_id string, pts_ms long"), 100, 5000).collect())
    want = []
    for w in range(4):
        slot = w * 5000
        for t in (t for t in pts if t // 5000 == w):
            if t >= slot:
                want.append(t)
                slot += 100
                if slot <= t:
                    slot = t + 100
    assert got == want
