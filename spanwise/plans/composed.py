"""Registered queries that compose operators: edit lists, snapped plans, separation, queues, stand-in models, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanwise.functions import models, pictures
from spanwise.functions import scalar as S
from spanwise.operators import audio, intervals, planning, tracks
from spanwise.operators.numbering import numbered
from spanwise.plans.catalogue import _DILATED, EV, FACE, GATE, JOBS, ORACLES, PCM, TRACK, _gate_intervals, _intervals, _music, _pcm, _streamed, _tracked, query
from spanwise.session import shared_folder
from spanwise.sources import fixtures as src
from spanwise.streaming import twins

# ------------------------------------------------------------------ edit lists

_PAD = "greatest(0e0, least(1e0, l - (r - l) * 0.25e0)) AS l, greatest(0e0, least(1e0, t - (b - t) * 0.25e0)) AS t, greatest(0e0, least(1e0, r + (r - l) * 0.25e0)) AS r, greatest(0e0, least(1e0, b + (b - t) * 0.25e0)) AS b"
_VOTED = """v1 AS (SELECT *, coalesce(max(px) OVER (PARTITION BY video_id, track_key ORDER BY pts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM track WHERE px >= 80 AND tracking_id IS NOT NULL),
 v2 AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_key ORDER BY pts_ms, event_id) AS n FROM v1 WHERE px > best),
 v3 AS (SELECT video_id, track_key, count(*) FILTER (WHERE vote = 1) AS male, count(*) FILTER (WHERE vote = -1) AS female FROM v2 WHERE n <= 5 GROUP BY 1, 2),
 cs AS (SELECT span.* FROM span LEFT JOIN v3 USING (video_id, track_key) WHERE NOT coalesce(male > female, false)),
 pd AS (SELECT track.video_id, track_key, event_id, pts_ms, """ + _PAD + """ FROM track JOIN cs USING (video_id, track_key)),
 ct AS (SELECT video_id, track_key, event_id, pts_ms, CASE length(video_id) % 4 WHEN 1 THEN t WHEN 2 THEN 1 - r WHEN 3 THEN 1 - b ELSE l END AS l, CASE length(video_id) % 4 WHEN 1 THEN 1 - r WHEN 2 THEN 1 - b WHEN 3 THEN l ELSE t END AS t,
   CASE length(video_id) % 4 WHEN 1 THEN b WHEN 2 THEN 1 - l WHEN 3 THEN 1 - t ELSE r END AS r, CASE length(video_id) % 4 WHEN 1 THEN 1 - l WHEN 2 THEN 1 - t WHEN 3 THEN r ELSE b END AS b FROM pd),
 st AS (SELECT video_id, t, sum(d) AS d FROM (SELECT video_id, start_ms AS t, 1 AS d FROM cs UNION ALL SELECT video_id, end_ms + 1, -1 FROM cs) GROUP BY 1, 2),
 ac AS (SELECT video_id, t, sum(d) OVER (PARTITION BY video_id ORDER BY t) AS n, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS nt FROM st),
 fu AS (SELECT video_id, s, e FROM iv UNION ALL SELECT video_id, t, nt - 1 FROM ac WHERE n > 8)"""
_EDL = f"{GATE}, {_intervals(40, 'iv')}, {TRACK[len(EV) + 2 :]}, {_VOTED}"


def _censored(spark, d):
    """Detections of the tracks to cover, with padded rectangles turned into stored space, and their spans."""
    tracked = _tracked(spark, d)
    v = tracks.votes(tracked)
    hidden = v.where(tracks.should_censor(F.col("female"), F.col("male"), F.lit("women"))).select("video_id", "track_key")
    own = tracked.join(hidden, ["video_id", "track_key"], "left_semi")
    (left, right), (top, bottom) = S.padded(F.col("l"), F.col("r")), S.padded(F.col("t"), F.col("b"))
    boxed = own.select("video_id", "track_key", "event_id", "pts_ms", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias(n) for c, n in ((left, "l"), (top, "t"), (right, "r"), (bottom, "b"))])
    turned = boxed.withColumn("_q", S.rotated(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.length("video_id") % 4 * 90))
    return turned.select("video_id", "track_key", "event_id", "pts_ms", *[F.col(f"_q.{c}").alias(c) for c in "ltrb"]), tracks.spans(own)


def _full_frames(spark, d, spans):
    """Gate intervals and the stretches with more faces than can be covered one by one."""
    busy = intervals.overlaps(spans.select("video_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), tracks.TOP, ["video_id"])
    return _gate_intervals(spark, d).select("video_id", "s", "e").unionByName(busy)


@query(f"""WITH {_EDL}, op AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.video_id = fr.video_id AND fr.pts_ms BETWEEN s AND e)),
 hit AS (SELECT op.video_id, op.pts_ms AS ft, track_key FROM op JOIN cs ON cs.video_id = op.video_id AND op.pts_ms BETWEEN start_ms AND end_ms),
 fa AS (SELECT hit.video_id, hit.ft, hit.track_key, arg_max(struct_pack(p := k.pts_ms, l := k.l, t := k.t, r := k.r, b := k.b), struct_pack(a := k.pts_ms, b := k.event_id)) FILTER (WHERE k.pts_ms <= ft) AS p0,
   arg_min(struct_pack(p := k.pts_ms, l := k.l, t := k.t, r := k.r, b := k.b), struct_pack(a := k.pts_ms, b := k.event_id)) FILTER (WHERE k.pts_ms > ft) AS p1 FROM hit JOIN ct k ON k.video_id = hit.video_id AND k.track_key = hit.track_key GROUP BY 1, 2, 3),
 pl AS (SELECT video_id, ft, track_key, {", ".join(f"floor((CASE WHEN p0 IS NULL THEN p1.{c} WHEN p1 IS NULL OR ft <= p0.p THEN p0.{c} ELSE p0.{c} + (p1.{c} - p0.{c}) * ((ft - p0.p) / (p1.p - p0.p)) END) * 1e6 + 0.5e0) / 1e6 AS {c}" for c in "ltrb")} FROM fa),
 rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, ft ORDER BY floor((r - l) * (b - t) * 1e9 + 0.5e0) DESC, track_key) AS rank FROM pl)
 SELECT video_id, ft AS pts_ms, track_key, l, t, r, b, rank FROM rk WHERE rank <= 8""")
def edl(spark, d):
    """What is covered in every frame: verdicts, padding, rotation, promotion of crowded stretches, full frames first, top 8."""
    boxes, spans = _censored(spark, d)
    return tracks.regions(src.faces(spark, d), boxes, _full_frames(spark, d, spans))


@query(f"WITH {_EDL} SELECT 'interval' AS kind, video_id, s, e, NULL::BIGINT AS at, NULL::DOUBLE AS l, NULL::DOUBLE AS t, NULL::DOUBLE AS r, NULL::DOUBLE AS b FROM iv UNION ALL SELECT 'keyframe', video_id, start_ms, end_ms, pts_ms, l, t, r, b FROM ct JOIN cs USING (video_id, track_key)")
def edl_documents(spark, d):
    """Edit lists as JSON, one document per video and five minutes, written and read back: intervals, tracks, ordered keyframes."""
    boxes, spans = _censored(spark, d)
    keys = boxes.groupBy("video_id", "track_key").agg(F.array_sort(F.collect_list(F.struct("pts_ms", "event_id", "l", "t", "r", "b"))).alias("k"))  # one track's detections
    frames = F.transform("k", lambda x: F.array(x["pts_ms"].cast("double"), x["l"], x["t"], x["r"], x["b"]))
    each = spans.join(keys, ["video_id", "track_key"]).select("video_id", F.floor(F.col("start_ms") / 300_000).alias("part"), F.struct(F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), frames.alias("keyframes")).alias("x"))
    of_tracks = each.groupBy("video_id", "part").agg(F.collect_list("x").alias("faceTracks"))
    of_gate = _gate_intervals(spark, d).groupBy("video_id", F.floor(F.col("s") / 300_000).alias("part")).agg(F.collect_list(F.array("s", "e")).alias("censorIntervalsMs"))
    none = F.array()
    whole = of_tracks.join(of_gate, ["video_id", "part"], "full").select("video_id", "part", F.to_json(F.struct(F.coalesce("censorIntervalsMs", none.cast("array<array<bigint>>")).alias("censorIntervalsMs"), F.coalesce("faceTracks", none.cast(of_tracks.schema["faceTracks"].dataType)).alias("faceTracks"))).alias("document"))
    path = f"{shared_folder(spark)}/edl-{uuid.uuid4().hex}"
    whole.write.parquet(path)
    back = spark.read.schema(whole.schema).parquet(path).select("video_id", F.from_json("document", "censorIntervalsMs array<array<bigint>>, faceTracks array<struct<startMs:bigint,endMs:bigint,keyframes:array<array<double>>>>").alias("x"))
    gone = F.lit(None)
    spans_back = back.select(F.lit("interval").alias("kind"), "video_id", F.explode("x.censorIntervalsMs").alias("i")).select("kind", "video_id", F.col("i")[0].alias("s"), F.col("i")[1].alias("e"), gone.cast("long").alias("at"), *[gone.cast("double").alias(c) for c in "ltrb"])
    tracks_back = back.select("video_id", F.explode("x.faceTracks").alias("t")).select("video_id", F.col("t.startMs").alias("s"), F.col("t.endMs").alias("e"), F.explode("t.keyframes").alias("k"))
    return spans_back.unionByName(tracks_back.select(F.lit("keyframe").alias("kind"), "video_id", "s", "e", F.col("k")[0].cast("long").alias("at"), *[F.col("k")[j].alias(c) for j, c in enumerate("ltrb", 1)]))


@query(f"WITH {TRACK} SELECT video_id, track_key, start_ms, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, track_key) AS place FROM span")
def track_order(spark, d):
    """Tracks in the order of their starts; equal starts keep the order in which tracks end."""
    spans = numbered(tracks.spans(_tracked(spark, d)), ["video_id"], F.floor(F.col("start_ms") / 10_000), ["start_ms", "end_ms", "track_key"], "place")
    return spans.select("video_id", "track_key", "start_ms", (F.col("place") + 1).alias("place"))


@query(f"WITH {GATE}, {_intervals(40, 'iv')}, {TRACK[len(EV) + 2 :]}, {_VOTED}, n AS (SELECT video_id, count(*) AS tracks FROM span GROUP BY 1), c AS (SELECT video_id, count(*) AS censored FROM cs GROUP BY 1), f AS (SELECT video_id, count(*) AS faces, count(*) FILTER (WHERE tracking_id IS NULL) AS untracked FROM face GROUP BY 1) SELECT video_id, tracks, faces, untracked, tracks - coalesce(censored, 0) AS spared FROM n JOIN f USING (video_id) LEFT JOIN c USING (video_id)")
def track_counters(spark, d):
    tracked = _tracked(spark, d)
    hidden = tracks.should_censor(F.col("female"), F.col("male"), F.lit("women"))
    counts = tracks.votes(tracked).groupBy("video_id").agg(F.count("*").alias("tracks"), F.count_if(~hidden).alias("spared"))
    faces = tracked.groupBy("video_id").agg(F.count("*").alias("faces"), F.count_if(F.col("tracking_id").isNull()).alias("untracked"))
    return counts.join(faces, "video_id").select("video_id", "tracks", "faces", "untracked", "spared")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))")
def untouched_jobs(spark, d):
    """Jobs whose edit list has neither intervals nor tracks: their picture passes through."""
    rows = src.table(spark, d, "lineitem")
    jobs = src.table(spark, d, "orders").select("o_orderkey")
    for flag in ("A", "R"):
        jobs = jobs.join(rows.where(F.col("l_returnflag") == flag).select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return jobs


# ------------------------------------------------------------------ plans and resuming


_SNAP = JOBS + """, vd AS (SELECT id AS video_id, duration_ms FROM jobs WHERE duration_ms > 300000 AND duration_ms >= 1800000), ky AS (SELECT l_orderkey AS video_id, l_linenumber * 700000 + l_partkey AS t FROM lineitem),
 nm AS (SELECT video_id, duration_ms, i * 300000 AS t FROM (SELECT *, unnest(range(1, CAST((duration_ms + 299999) // 300000 AS BIGINT))) AS i FROM vd)),
 sn AS (SELECT nm.video_id, nm.t, any_value(duration_ms) AS dm, min(ky.t) AS k FROM nm LEFT JOIN ky ON ky.video_id = nm.video_id AND ky.t >= nm.t GROUP BY 1, 2),
 cu AS (SELECT video_id, least(dm, coalesce(k, dm)) AS c FROM sn UNION SELECT video_id, 0 FROM vd UNION SELECT video_id, duration_ms FROM vd),
 pl AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY c) - 1 AS idx, c AS start_ms, lead(c) OVER (PARTITION BY video_id ORDER BY c) AS end_ms FROM cu)"""


@query(f"WITH {_SNAP} SELECT * FROM pl WHERE end_ms IS NOT NULL")
def snapped_plan(spark, d):
    """Cuts moved to the next keyframe; to the end where none follows."""
    keys = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * 700_000 + F.col("l_partkey")).alias("t"))
    videos = src.jobs(spark, d).select(F.col("id").alias("video_id"), "duration_ms")
    return planning.snapped_plan(videos, keys).withColumn("idx", F.col("idx").cast("long"))


@query(
    "WITH j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 0 ELSE floor(o_totalprice * 40)::BIGINT END AS emitted, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 <> 0 THEN 0 ELSE floor(o_totalprice * 40)::BIGINT END AS total, floor(o_totalprice * 40)::BIGINT * 4 - o_custkey % 1000 * 16 + 3 AS held, floor(o_totalprice * 60)::BIGINT AS frames FROM orders), w AS (SELECT *, least(emitted, held // 4) AS written FROM j) "
    "SELECT id, written, held - written * 4 AS cut, greatest((22050 + written) // 103194 - 1, 0) AS skip, CAST(ceil((frames + 22050) / 103194e0) AS BIGINT) - greatest((22050 + written) // 103194 - 1, 0) AS left_chunks, total > 0 AND written >= total AS complete FROM w"
)
def resume_chunks(spark, d):
    """Where a run goes on: the least of checkpoint and file, what is cut off, chunks to skip and to do; broken checkpoints count as none."""
    i, price = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.floor(price * 40)
    document = F.when(i % 7 == 0, "{broken").when(i % 5 != 0, F.to_json(F.struct(whole.alias("framesEmitted"), F.when(i % 4 == 0, whole).otherwise(0).alias("frames"), F.lit(0.5).alias("mean"), F.lit(2.0).alias("std"))))
    j = src.table(spark, d, "orders").select(i.alias("id"), F.from_json(document, "framesEmitted bigint, frames bigint, mean double, std double").alias("x"), (whole * 4 - F.col("o_custkey") % 1000 * 16 + 3).alias("held"), F.floor(price * 60).alias("frames"))
    total, written = F.coalesce("x.frames", F.lit(0)), F.least(F.coalesce("x.framesEmitted", F.lit(0)), F.floor(F.col("held") / 4))
    w = j.select("id", "held", "frames", total.alias("total"), written.alias("written")).withColumn("skip", audio.skipped_chunks(F.col("written")))
    chunks = F.ceil((F.col("frames") + audio.LEAD) / audio.STRIDE)
    return w.select("id", "written", (F.col("held") - F.col("written") * 4).alias("cut"), "skip", (chunks - F.col("skip")).alias("left_chunks"), ((F.col("total") > 0) & (F.col("written") >= F.col("total"))).alias("complete"))


_CLIP = "CASE WHEN abs({0}) <= 0.95 THEN {0} ELSE sign({0}) * (0.95e0 + tanh((abs({0}) - 0.95e0) / 0.05e0) * 0.05e0) END"


@query(f"WITH {PCM} SELECT track_id, i, round({_CLIP.format('l')}, 6) AS l, round({_CLIP.format('r')}, 6) AS r FROM pcm")
def separator_identity(spark, d):
    """A model that gives back what it gets: the chunk driver returns the soft-clipped sound."""
    out = audio.separate(_pcm(spark, d), "track_id", lambda wave: wave, 1200, 1080, 220)
    return out.select("track_id", "i", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query(f"WITH {PCM}, n AS (SELECT track_id, count(*) // 2 AS written FROM pcm GROUP BY 1) SELECT track_id, i, round({_CLIP.format('l')}, 6) AS l, round({_CLIP.format('r')}, 6) AS r FROM pcm JOIN n USING (track_id) WHERE i >= written")
def separator_resumed(spark, d):
    """The same, resumed half-way: only later samples, equal to the full run's."""
    pcm = _pcm(spark, d)
    done = pcm.groupBy("track_id").agg(F.floor(F.count("*") / 2).alias("written"))
    out = audio.separate(pcm, "track_id", lambda wave: wave, 1200, 1080, 220, done)
    return out.select("track_id", "i", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query(f"WITH {PCM} SELECT track_id, i // 4096 AS block, count(*) AS n, sum(greatest(-32768, least(32767, floor(l * 32767 + 0.5e0))))::BIGINT AS total FROM pcm GROUP BY 1, 2")
def pcm_blocks(spark, d):
    """16-bit samples written as blocks of bytes and scanned again block by block."""
    import numpy as np
    import pandas as pd

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [key[0]], "block": [key[1]], "pcm": [rows.sort_values("i").q.to_numpy().astype("<i2").tobytes()]})

    def scan(batches):
        for rows in batches:
            samples = [np.frombuffer(b, dtype="<i2").astype(np.int64) for b in rows.pcm]
            yield pd.DataFrame({"track_id": rows.track_id, "block": rows.block, "n": [len(s) for s in samples], "total": [int(s.sum()) for s in samples]})

    q = _pcm(spark, d).select("track_id", F.floor(F.col("i") / 4096).alias("block"), "i", S.quantized(F.col("l")).alias("q"))
    path = f"{shared_folder(spark)}/pcm-{uuid.uuid4().hex}"
    q.groupBy("track_id", "block").applyInPandas(pack, "track_id string, block long, pcm binary").write.parquet(path)
    return spark.read.parquet(path).mapInPandas(scan, "track_id string, block long, n long, total long")


# ------------------------------------------------------------------ queue


_STEPS = (("added", "PENDING_DOWNLOAD"), ("download", "DOWNLOADING"), ("filter", "FILTERING"), ("finish", "DONE"), ("fail", "FAILED"))


@query(
    f"WITH {EV}, e AS (SELECT user_id AS id, pts_ms, event_id, ['added', 'download', 'filter', 'finish', 'fail', 'retry', 'stop', 'cancel'][(event_id * 7919 % 8 + 1)::INT] AS kind FROM ev), s AS (SELECT *, CASE kind WHEN 'added' THEN 'PENDING_DOWNLOAD' WHEN 'download' THEN 'DOWNLOADING' WHEN 'filter' THEN 'FILTERING' WHEN 'finish' THEN 'DONE' WHEN 'fail' THEN 'FAILED' WHEN 'retry' THEN CASE WHEN id % 2 = 0 THEN 'PENDING_FILTER' ELSE 'PENDING_DOWNLOAD' END END AS state FROM e), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pts_ms, event_id) AS n FROM s), a AS (SELECT id, max(n) FILTER (WHERE kind = 'cancel') AS gone, max(n) FILTER (WHERE kind = 'added') AS came, arg_max(state, n) FILTER (WHERE state IS NOT NULL) AS last FROM o GROUP BY 1) SELECT id, CASE WHEN came IS NULL OR coalesce(gone, 0) > came THEN NULL ELSE last END AS state, came IS NOT NULL AND coalesce(gone, 0) < came AND last NOT IN ('DONE', 'FAILED') AS active FROM a"
)
def queue_transitions(spark, d):
    """Last state of every queue item: a transition table joined to its events; after a cancel only a new add counts; a stop leaves the state."""
    kinds = F.array(*[F.lit(k) for k in ("added", "download", "filter", "finish", "fail", "retry", "stop", "cancel")])
    e = src.events(spark, d).select(F.col("user_id").alias("id"), F.struct("pts_ms", "event_id").alias("at"), F.element_at(kinds, (F.col("event_id") * 7919 % 8 + 1).cast("int")).alias("kind"))
    known = spark.createDataFrame([(k, p, s) for k, s in _STEPS for p in (0, 1)] + [("retry", 0, "PENDING_FILTER"), ("retry", 1, "PENDING_DOWNLOAD")], "kind string, odd long, state string")
    moved = e.withColumn("odd", F.col("id") % 2).join(F.broadcast(known), ["kind", "odd"], "left")
    a = moved.groupBy("id").agg(F.max(F.when(F.col("kind") == "cancel", F.col("at"))).alias("gone"), F.max(F.when(F.col("kind") == "added", F.col("at"))).alias("came"), F.max_by("state", F.when(F.col("state").isNotNull(), F.col("at"))).alias("last"))
    there = F.col("came").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("came")))
    final = a.select("id", F.when(there, F.col("last")).alias("state"), (there & ~F.col("last").isin(*S.TERMINAL)).alias("active"))
    path = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    final.write.parquet(path)  # the whole queue at once; the commit makes it visible
    return spark.read.schema(final.schema).parquet(path)


@query(f"WITH {JOBS}, x AS (SELECT l_orderkey AS id, l_partkey % 4 AS what FROM lineitem WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) = 1) SELECT id, CASE WHEN what = 1 THEN 'DONE' ELSE state END AS state FROM jobs LEFT JOIN x USING (id) WHERE what IS DISTINCT FROM 2 UNION ALL SELECT id + 1000000000, 'PENDING_DOWNLOAD' FROM x WHERE what = 3")
def queue_edits(spark, d):
    """A list with items replaced, removed and appended."""
    x = src.table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("id")).agg((F.min(F.struct("l_partkey", "l_suppkey"))["l_partkey"] % 4).alias("what"))
    held = src.jobs(spark, d).select("id", "state").join(x, "id", "left").where(~F.col("what").eqNullSafe(F.lit(2)))
    changed = held.select("id", F.when(F.col("what") == 1, "DONE").otherwise(F.col("state")).alias("state"))
    return changed.unionByName(x.where("what = 3").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("PENDING_DOWNLOAD").alias("state")))


@query(f"WITH {JOBS} SELECT id FROM jobs j WHERE state = 'PENDING_DOWNLOAD' AND NOT EXISTS (SELECT 1 FROM jobs q WHERE q.url = j.url AND q.id < j.id AND q.state NOT IN ('DONE', 'FAILED')) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = j.id AND l_linenumber = 1 AND l_partkey % 3 = 0)")
def running_dedupe(spark, d):
    """Jobs to start: no earlier live job has their link, and no running work has their tag."""
    j = src.jobs(spark, d)
    tags = src.table(spark, d, "lineitem").where("l_linenumber = 1 and l_partkey % 3 = 0").select(F.concat(F.lit("item:"), "l_orderkey").alias("tag"))
    first = j.where(~F.col("state").isin(*S.TERMINAL)).groupBy("url").agg(F.min("id").alias("first"))
    waiting = j.where("state = 'PENDING_DOWNLOAD'").join(first, "url").where("id = first")
    return waiting.join(tags, F.concat(F.lit("item:"), F.col("id")) == F.col("tag"), "left_anti").select("id")


# ------------------------------------------------------------------ stand-in models


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), s AS (SELECT *, abs(x[1]) + abs(x[2]) + abs(x[3]) + abs(x[4]) + abs(x[5]) AS t, vec_id % 64 AS n FROM e) SELECT vec_id, round(abs(x[1]) / t, 6) AS first_class, CASE WHEN vec_id % 11 <> 0 THEN round(x[3], 6) END AS attribute, CASE WHEN n = 0 THEN 0e0 ELSE round(list_sum(list_transform(x[1:n], lambda v: abs(v))) / n, 6) END AS music, CASE WHEN vec_id % 13 = 0 THEN 0 WHEN 1 / (1 + exp(-(x[2] - x[1]))) BETWEEN 0.4e0 AND 0.6e0 THEN 0 WHEN x[2] >= x[1] THEN 1 ELSE -1 END AS vote FROM s")
def stub_models(spark, d):
    """Five classes, an attribute or none, a music score of the real samples, and a vote that fails to 0."""
    import numpy as np

    def vote(a, b):
        if np.isnan(a):
            raise ValueError("no crop")
        p = 1 / (1 + np.exp(-(b - a)))
        return 0 if max(p, 1 - p) < 0.6 else 1 if p >= 0.5 else -1

    classes = models.per_row(lambda: lambda x: (np.abs(x[:5]) / np.abs(x[:5]).sum()).tolist(), "array<double>")
    attributes = models.per_row(lambda: lambda x: x[:3].tolist(), "array<double>")
    score, ballot = models.music_score(lambda: lambda x: np.abs(x).mean()), models.voter(lambda: vote)
    e = src.table(spark, d, "embeddings").select("vec_id", "embedding")
    left = F.when(F.col("vec_id") % 13 != 0, F.element_at("embedding", 1).cast("double")).otherwise(float("nan"))
    out = e.select("vec_id", classes("embedding").alias("c"), attributes(F.when(F.col("vec_id") % 11 != 0, F.col("embedding"))).alias("a"), score("embedding", (F.col("vec_id") % 64).cast("int")).alias("m"), ballot(left, F.element_at("embedding", 2).cast("double")).alias("vote"))
    return out.select("vec_id", F.round(F.get("c", F.lit(0)), 6).alias("first_class"), F.round(F.get("a", F.lit(2)), 6).alias("attribute"), F.round("m", 6).alias("music"), "vote")


@query("SELECT p_partkey, unnest(range(0, p_size % 4)) AS frame, unnest(range(0, p_size % 4)) * 200 AS pts_ms FROM part")
def emitted_frames(spark, d):
    """A table-valued function: as many frames as a clip has."""
    return models.frames(src.table(spark, d, "part").select("p_partkey", "p_size"), lambda row: [(int(row.p_partkey), k, k * 200) for k in range(int(row.p_size) % 4)], "p_partkey long, frame long, pts_ms long")


@query("WITH o AS (SELECT o_orderkey, o_custkey % 4 * 90 AS deg FROM orders), p AS (SELECT *, unnest(range(0, 8)) AS y FROM o), q AS (SELECT *, unnest(range(0, 6)) AS x FROM p), v AS (SELECT *, CASE deg WHEN 90 THEN 7 - x ELSE y END AS y0 FROM q) SELECT o_orderkey, deg, CASE WHEN deg IN (90, 270) THEN 8 ELSE 6 END AS width, CASE WHEN deg IN (90, 270) THEN 6 ELSE 8 END AS height, CASE deg WHEN 0 THEN o_orderkey % 200 WHEN 90 THEN (o_orderkey + 7 * 6) % 200 WHEN 180 THEN (o_orderkey + 47) % 200 ELSE (o_orderkey + 5) % 200 END AS corner FROM v WHERE y = 0 AND x = 0")
def turned_pictures(spark, d):
    """Planes to a float tensor (channels, height, width) in [0, 1], turned upright; its shape and first value."""
    import numpy as np
    import pandas as pd

    def apply(batches):
        for rows in batches:
            keys = rows.o_orderkey.to_numpy()
            planes = np.concatenate([(np.arange(48) + keys[:, None]) % 200, np.full((len(keys), 24), 128)], axis=1)
            for (deg,), at in pictures.by_shape(rows.deg.to_numpy()):
                tensors = pictures.tensors(planes[at], 6, 8, deg)
                corner = np.round(tensors[:, 0, 0, 0] * 255).astype(int)
                yield pd.DataFrame({"o_orderkey": keys[at], "deg": deg, "width": tensors.shape[-1], "height": tensors.shape[-2], "corner": corner})

    return src.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4 * 90).alias("deg")).mapInPandas(apply, "o_orderkey long, deg long, width long, height long, corner long")


ORACLES["pixel_pack"] = """SELECT o_orderkey, 72 AS n_bytes, (SELECT sum(((2 * i * 16 + 2 * j) * 7 + o_orderkey) % 256) FROM range(0, 6) a(i), range(0, 8) b(j))::BIGINT
 + (SELECT sum(((2 * i * 8 + 2 * j) * 5 + o_orderkey) % 256 + ((2 * i * 8 + 2 * j) * 3 + o_orderkey) % 256) FROM range(0, 3) a(i), range(0, 4) b(j))::BIGINT AS total FROM orders"""


# ------------------------------------------------------------------ streams


def _face_stream(spark, d):
    return src.faces(spark, d).where("tracking_id is not null").select("video_id", "tracking_id", F.timestamp_millis("pts_ms").alias("ts"))


@query(f"WITH {FACE}, a AS (SELECT video_id, tracking_id, pts_ms, event_id, lag(pts_ms) OVER w AS p FROM face WHERE tracking_id IS NOT NULL WINDOW w AS (PARTITION BY video_id, tracking_id ORDER BY pts_ms, event_id)), g AS (SELECT *, sum(CASE WHEN p IS NULL OR pts_ms - p >= 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, tracking_id ORDER BY pts_ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT video_id, tracking_id, min(pts_ms) AS first_ms, max(pts_ms) AS last_ms, count(*) AS n FROM g GROUP BY video_id, tracking_id, s")
def stream_tracks(spark, d):
    """Tracks closed by event time, read as a stream."""
    out = _streamed(spark, _face_stream(spark, d), twins.track_spans)
    return out.select("video_id", "tracking_id", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), "n")


@query(f"WITH {EV} SELECT video_id, pts_ms // 300000 * 300000 AS start_ms, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_segments(spark, d):
    """Frames per five-minute segment, read as a stream."""
    rows = src.events(spark, d).select("video_id", F.timestamp_millis("pts_ms").alias("ts"))
    return _streamed(spark, rows, twins.segments).select("video_id", F.unix_millis("window.start").alias("start_ms"), "n")


@query(f"WITH {EV}, h AS (SELECT video_id, unnest([pts_ms // 60000 * 60000, pts_ms // 60000 * 60000 - 60000]) AS start_ms FROM ev) SELECT video_id, start_ms, count(*) AS n FROM h GROUP BY 1, 2")
def stream_hops(spark, d):
    """Frames per two-minute window begun every minute, read as a stream."""
    rows = src.events(spark, d).select("video_id", F.timestamp_millis("pts_ms").alias("ts"))
    return _streamed(spark, rows, lambda s: twins.hops(s, "2 minutes", "1 minute")).select("video_id", F.unix_millis("window.start").alias("start_ms"), "n")


@query(f"WITH {JOBS} SELECT DISTINCT url FROM jobs")
def stream_links(spark, d):
    """Each link once within the watermark, read as a stream."""
    rows = src.jobs(spark, d).select("url", F.col("added").cast("timestamp").alias("ts"))
    return _streamed(spark, rows, lambda s: twins.deduped(s, delay="10000 days"), "append").select("url")


@query(f"{_DILATED} SELECT * FROM dl")
def stream_dilation(spark, d):
    """Which chunks to separate, two chunks late, read as a stream."""
    music = _music(spark, d)
    end = music.groupBy("video_id").agg((F.max("chunk") + 1).alias("chunk")).withColumn("score", F.lit(None).cast("float"))
    return _streamed(spark, music.unionByName(end), twins.dilation, "append")
