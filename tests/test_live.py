"""Streams whose state is closed by event time: many deliveries, rows out of order, rows behind the watermark."""

import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwise.operators import tracks
from spanwise.streaming import append, live

FACES = "video_id string, ts timestamp, event_id long, tracking_id long, px int, vote int, l double, t double, r double, b double, ends boolean"


DAY = 86_400_000


def at(ms, origin=0):
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=ms + origin)


def face_rows(rng, videos=("v", "w"), frames=60):
    rows = []
    for v in videos:
        pts = 0
        for _ in range(frames):
            pts += rng.choice([100, 200, 700, 2600])
            for _ in range(rng.randrange(3)):
                e = len(rows)
                rows.append((v, at(pts), e, rng.choice([None, 1, 2, 3, 4]), rng.randrange(40, 200), rng.randrange(-1, 2), *[round(rng.random(), 3) for _ in range(4)], False))
    return rows


def in_parts(spark, rows, schema, n, rng, jitter_ms):
    """Rows dealt to deliveries by time, shuffled by at most ``jitter_ms`` around it."""
    moved = sorted(rows, key=lambda r: r[1] + timedelta(milliseconds=rng.randrange(jitter_ms + 1)))
    cut = [len(moved) * k // n for k in range(n + 1)]
    return [spark.createDataFrame(moved[a:b], schema).repartition(2) for a, b in zip(cut, cut[1:])]


def seen_total(progress):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


def dropped(progress):
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def batch_tracks(spark, rows):
    table = spark.createDataFrame(rows, FACES).withColumn("pts_ms", F.unix_millis("ts"))
    tracked = tracks.sessions(table)
    first = tracked.groupBy("video_id", "track_key").agg(F.min_by("event_id", F.struct("pts_ms", "event_id")).alias("first_event"), F.first("tracking_id").alias("tracking_id"))
    both = tracks.spans(tracked).join(tracks.votes(tracked), ["video_id", "track_key"]).join(first, ["video_id", "track_key"])
    return {(r.video_id, r.tracking_id, r.first_event, r.start_ms, r.end_ms, r.n_keyframes, r.male, r.female, r.tried, not r.male > r.female) for r in both.collect()}


def test_tracks_close_by_event_time(spark, tmp_path):
    rng = random.Random(4)
    rows = face_rows(rng)
    end = max(r[1] for r in rows) + timedelta(seconds=3)
    ends = [(v, end, None, None, None, None, None, None, None, None, True) for v in "vw"]
    beat = [("~", end + timedelta(minutes=5), None, None, None, None, None, None, None, None, False)]
    parts = in_parts(spark, rows, FACES, 4, rng, 1500) + [spark.createDataFrame(ends, FACES), spark.createDataFrame(beat, FACES)]
    out, progress = append.delivered(parts, lambda s: live.face_tracks(s, parts=3), str(tmp_path / "run"))
    got = out.collect()
    assert {tuple(r)[:10] for r in got} == batch_tracks(spark, rows) and len(got) == len(batch_tracks(spark, rows))
    by_event = {r[2]: r for r in rows}
    for r in got:
        assert len(r.keyframes) == r.n_keyframes and (r.keyframes[0].l, r.keyframes[0].b) == (by_event[r.first_event][6], by_event[r.first_event][9])
        assert [k.pts_ms for k in r.keyframes] == sorted(k.pts_ms for k in r.keyframes)
    totals = seen_total(progress)
    assert dropped(progress) == 0 and len(progress) > 5
    assert totals[-1] < max(totals) / 4  # ids that closed have left the state


def test_rows_behind_the_watermark(spark, tmp_path):
    """A row inside the delay is kept wherever it arrives; one behind the watermark is dropped and counted."""
    face = lambda ms, e, name=1: ("v", at(ms), e, name, 100, 1, 0.0, 0.0, 1.0, 1.0, False)
    beat = ("~", at(100_000), None, None, None, None, None, None, None, None, False)
    first = [face(1000, 1), face(2000, 2), face(10_000, 3, 2)]  # the watermark is 8000 now
    second = [face(9000, 4, 2), face(7000, 5, 1), face(8500, 6, 3), face(30_000, 7, 4)]
    last = [("v", at(40_000), None, None, None, None, None, None, None, None, True)]
    parts = [spark.createDataFrame(x, FACES) for x in (first, second, last, [beat])]
    out, progress = append.delivered(parts, lambda s: live.face_tracks(s, parts=1), str(tmp_path / "run"))
    kept = [r for r in first + second if r[2] != 5]
    assert dropped(progress) == 1
    assert {tuple(r)[:10] for r in out.collect()} == batch_tracks(spark, kept)


def test_rows_at_time_zero(spark, tmp_path):
    """With an origin, rows of media time 0 are not behind the first watermark."""
    face = lambda ms, e: ("v", at(ms, DAY), e, 1, 100, 1, 0.0, 0.0, 1.0, 1.0, False)
    moves = lambda ms, ends: ("v" if ends else "~", at(ms, DAY), *[None] * 8, ends)
    parts = [spark.createDataFrame(x, FACES) for x in ([face(0, 1), face(500, 2)], [moves(9000, True)], [moves(99_000, False)])]
    out, progress = append.delivered(parts, lambda s: live.face_tracks(s, origin=DAY), str(tmp_path / "run"))
    assert [tuple(r)[:10] for r in out.collect()] == [("v", 1, 1, 0, 550, 2, 1, 0, 1, False)] and dropped(progress) == 0


def test_hysteresis_late_rows(spark, tmp_path):
    schema = "video_id string, ts timestamp"
    row = lambda ms, v="v": (v, at(ms))
    parts = [[row(200), row(10_000)], [row(8000), row(2201), row(12_001), row(1000)], [row(60_000)], [row(200_000, "~")]]
    durations = spark.createDataFrame([("v", 61_000)], "video_id string, duration_ms long")
    parts = [spark.createDataFrame(p, schema) for p in parts]
    out, progress = append.delivered(parts, lambda s: live.hysteresis(s, durations), str(tmp_path / "run"))
    # the watermark is 7000 when 2201 and 1000 come: both are late
    assert sorted(map(tuple, out.collect())) == [("v", 0, 1700), ("v", 7500, 13_501), ("v", 59_500, 61_000)]
    assert dropped(progress) == 2
    assert seen_total(progress)[-1] <= 1


def plain_chains(rows):
    queues, out = {}, []
    for chain, ts, kind, item, link in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        queue, ms = queues.setdefault(chain, []), round(ts.timestamp() * 1000)
        names = [q for q, _ in queue]
        if kind == "add" and (item in names or link in [l for _, l in queue]):
            out.append((chain, item, "duplicate", ms))
        elif kind == "add":
            queue.append((item, link))
            out += [(chain, item, "started", ms)] if not names else []
        elif names[:1] == [item]:
            queue.pop(0)
            out += [(chain, item, "ended", ms)] + ([(chain, queue[0][0], "started", ms)] if queue else [])
        elif item in names:
            queues[chain] = [q for q in queue if q[0] != item]
            out.append((chain, item, "cancelled", ms))
    return sorted(out)


def test_chains(spark, tmp_path):
    rng, schema = random.Random(9), "chain long, ts timestamp, kind string, item long, link string"
    rows = []
    for i in range(150):
        start = rng.randrange(100_000)
        rows.append((rng.randrange(4), at(start), "add", i, f"u{rng.randrange(40)}"))
        if rng.random() < 0.8:
            rows.append((rows[-1][0], at(start + rng.randrange(1, 20_000)), "end", i, None))
    rows.append((1, at(5), "end", 999, None))
    late = [(1, at(3), "add", 777, "late")]
    parts = in_parts(spark, rows, schema, 3, rng, 900)
    parts += [spark.createDataFrame(late, schema), spark.createDataFrame([(-1, at(10_000_000), "end", 0, None)], schema)]
    out, progress = append.delivered(parts, lambda s: live.chains(s, "1 second"), str(tmp_path / "run"))
    assert sorted(map(tuple, out.collect())) == plain_chains(rows)
    assert dropped(progress) == 1


# exactly once


def appended(spark, folder, interrupt=lambda n: False, session=None):
    schema = "id long, x double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").select("id", (F.col("x") * 2).alias("x"))
    table = append.AppendTable(spark, f"{folder}/out", stream.schema)
    return table, lambda: append.run(stream, table, f"{folder}/checkpoint", interrupt)


def test_interrupted_between_rows_and_marker(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(0, 1000, 1, 5).select("id", (F.col("id") / 7).alias("x"))
    rows.write.parquet(f"{folder}/in")
    want = sorted((r.id, r.x * 2) for r in rows.collect())
    table, go = appended(spark, folder, lambda n: n == 2)
    with pytest.raises(Exception, match="batch 2"):
        go()
    assert table.trusted() == 1 and 0 < table.read().count() < 1000
    assert set(table._counts()) == {0, 1, 2}  # rows of the batch are there, its marker is not
    table, go = appended(spark, folder)
    assert go() and sorted(map(tuple, table.read().collect())) == want
    assert table.trusted() >= 3  # what the cut batch had may come together with the next file
    go()  # nothing is left to do
    assert sorted(map(tuple, table.read().collect())) == want


@pytest.mark.parametrize("harm", ["short", "gone", "marker"])
def test_rows_or_markers_lost(spark, tmp_path, harm):
    """The shorter of rows and markers counts; the stream does the rest again, once."""
    folder = str(tmp_path)
    rows = spark.range(0, 600, 1, 4).select("id", (F.col("id") / 7).alias("x"))
    rows.write.parquet(f"{folder}/in")
    table, go = appended(spark, folder)
    go()
    batch = tmp_path / "out" / "rows" / "batch=1"
    if harm == "short":
        part = spark.read.parquet(str(batch)).limit(10).collect()
        spark.createDataFrame(part, "id long, x double").write.mode("overwrite").parquet(str(batch))
    elif harm == "gone":
        for f in batch.iterdir():
            f.unlink()
    else:
        (tmp_path / "out" / "markers" / "2").unlink()
    assert table.trusted() == (1 if harm == "marker" else 0)
    go()
    assert sorted(map(tuple, table.read().collect())) == sorted((r.id, r.x * 2) for r in rows.collect())


# what waits


class Cells(dict):
    """A map state or the timers of a key, by hand."""

    def getValue(self, k):
        return self[k]

    def containsKey(self, k):
        return k in self

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Cells())

    def registerTimer(self, ms):
        self.timers.add(ms)


def test_one_slot_at_a_time():
    """Rows of a delivery wait packed by slots; a turn gets those of one slot, in order, and what the watermark has not passed goes on waiting."""

    class Kept(live.InEventOrder):
        row, span = "at long, name string", 100

        def turn(self, key, rows):
            calls.append(rows)

    calls, handle, kept = [], Handle(), Kept()
    kept.init(handle)
    rng = random.Random(3)
    rows = [(t, rng.choice([None, "a", "b"])) for t in range(1000)]
    rng.shuffle(rows)
    frames = [pd.DataFrame(rows[k : k + 100], columns=["at", "name"]) for k in range(0, 1000, 100)]
    list(kept.handleInputRows(("v",), iter(frames), None))
    assert len(handle.states["waiting"]) == 10 and len(handle.timers) == 10
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 949)
    for ms in sorted(handle.timers):
        list(kept.handleExpiredTimer(("v",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))
    assert [len(c) for c in calls] == [100] * 9 + [50] and [r for c in calls for r in c] == sorted((r for r in rows if r[0] < 950))
    assert len(handle.states["waiting"]) == 1 and 950 in handle.timers


def test_chains_share_a_group():
    """A key is a group of chains; the chains of a group do not see each other's items."""
    turns = live.Chains()
    turns.queues = SimpleNamespace(exists=lambda: False, update=lambda v: None, clear=lambda: None)
    rows = [(1, "add", 1, "x", 7), (1, "add", 2, "x", 8), (2, "add", 3, "x", 7), (3, "end", 1, None, 7), (3, "end", 1, None, 8)]
    assert list(turns.turn((0,), rows).itertuples(index=False, name=None)) == [(7, 1, "started", 1), (8, 2, "started", 1), (7, 3, "duplicate", 2), (7, 1, "ended", 3)]
