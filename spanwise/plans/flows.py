"""Queries of streams in append mode, of whole videos and of whole tracks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanwise.operators import gate, sampler, spectra
from spanwise.session import shared_folder
from spanwise.sources import fixtures as src
from spanwise.streaming import append, live, separate

from .catalogue import EV, GATE, PCM, TRACK, _intervals, _pcm, query
from .composed import _CLIP

#: Media time 0 as event time: a day after the epoch, at which Spark's watermark begins.
DAY = 86_400_000


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ streams


@query(f"""WITH {TRACK}, pl AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_key ORDER BY pts_ms, event_id) AS place FROM track),
 vo AS (SELECT t.video_id, t.track_key, t.vote, row_number() OVER (PARTITION BY t.video_id, t.track_key ORDER BY t.place) AS n FROM pl t WHERE t.tracking_id IS NOT NULL AND px >= 80 AND NOT EXISTS (SELECT 1 FROM pl o WHERE o.video_id = t.video_id AND o.track_key = t.track_key AND o.place < t.place AND o.px >= t.px)),
 su AS (SELECT video_id, track_key, count(*) FILTER (WHERE vote = 1) AS male, count(*) FILTER (WHERE vote = -1) AS female, count(*) AS tried FROM vo WHERE n <= 5 GROUP BY 1, 2),
 fi AS (SELECT video_id, track_key, any_value(tracking_id) AS tracking_id, arg_min(event_id, place) AS first_event, round(arg_min(l, place), 6) AS first_l, round(arg_max(b, place), 6) AS last_b FROM pl GROUP BY 1, 2)
 SELECT video_id, tracking_id, first_event, start_ms, end_ms, n_keyframes, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(tried, 0) AS tried, NOT (coalesce(male, 0) > coalesce(female, 0)) AS censored, first_l, last_b
 FROM span JOIN fi USING (video_id, track_key) LEFT JOIN su USING (video_id, track_key)""")
def stream_face_tracks(spark, d):
    """Tracks closed by the time of the frames, with verdict and keyframes at the close, in append mode."""
    faces = src.faces(spark, d).select("video_id", F.timestamp_millis(F.col("pts_ms") + DAY).alias("ts"), "event_id", "tracking_id", "px", "vote", "l", "t", "r", "b", F.lit(False).alias("ends"))
    ends = faces.select("video_id").distinct().withColumn("ends", F.lit(True))
    end = append.behind(faces, 3)
    closing = [{**r.asDict(), "ts": end} for r in ends.collect()] if end else []  # the source says of each video when it is over
    rows = faces if not closing else faces.unionByName(spark.createDataFrame([[r.get(c) for c in faces.columns] for r in closing], faces.schema))
    out = append.by_time(rows, lambda s: live.face_tracks(s, origin=DAY), _folder(spark), [{"video_id": "~", "ts": 3600, "ends": False}] if closing else [])
    return out.select(*[c for c in out.columns if c != "keyframes"], F.round(F.col("keyframes")[0]["l"], 6).alias("first_l"), F.round(F.element_at("keyframes", -1)["b"], 6).alias("last_b"))


@query(f"WITH {GATE}, {_intervals(100, 'iv')} SELECT video_id, s, e FROM iv")
def stream_hysteresis_clamped(spark, d):
    """Intervals of firings inside their video, closed by session windows in append mode."""
    scores = src.gate_scores(spark, d)
    durations = src.events(spark, d).groupBy("video_id").agg(F.max("pts_ms").alias("duration_ms"))
    fired = gate.firings(scores, 100).select("video_id", F.timestamp_millis(F.col("pts_ms") + DAY).alias("ts"))
    return append.by_time(fired, lambda s: live.hysteresis(s, durations, origin=DAY), _folder(spark), [{"video_id": "~", "ts": 3600}])


@query("""WITH RECURSIVE ev AS (
  SELECT o_custkey AS chain, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS at_ms, 'add' AS kind, o_orderkey AS item, 'h' || (o_orderkey % 7) AS link FROM orders
  UNION ALL SELECT o_custkey, epoch_ms(CAST(done AS TIMESTAMP)), 'end', o_orderkey, NULL FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
 nu AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY at_ms, kind, item) AS n FROM ev),
 q AS (SELECT DISTINCT chain, 0::BIGINT AS n, []::BIGINT[] AS items, []::VARCHAR[] AS links, NULL::BIGINT AS item, NULL::VARCHAR AS what, NULL::BIGINT AS begun, NULL::BIGINT AS at_ms FROM nu
  UNION ALL SELECT q.chain, nu.n,
   CASE WHEN kind = 'end' THEN list_filter(items, lambda i: i <> nu.item) WHEN list_contains(items, nu.item) OR list_contains(links, nu.link) THEN items ELSE list_append(items, nu.item) END,
   CASE WHEN kind = 'end' THEN list_filter(links, lambda l, k: items[k] <> nu.item) WHEN list_contains(items, nu.item) OR list_contains(links, nu.link) THEN links ELSE list_append(links, nu.link) END,
   nu.item, CASE WHEN kind = 'add' AND (list_contains(items, nu.item) OR list_contains(links, nu.link)) THEN 'duplicate' WHEN kind = 'end' AND items[1] = nu.item THEN 'ended' WHEN kind = 'end' AND list_contains(items, nu.item) THEN 'cancelled' END,
   CASE WHEN kind = 'add' AND len(items) = 0 THEN nu.item WHEN kind = 'end' AND items[1] = nu.item THEN items[2] END, nu.at_ms
  FROM q JOIN nu ON nu.chain = q.chain AND nu.n = q.n + 1)
 SELECT chain, item, what, at_ms FROM q WHERE what IS NOT NULL UNION ALL SELECT chain, begun, 'started', at_ms FROM q WHERE begun IS NOT NULL""")
def stream_chains(spark, d):
    """The queue of every owner: items start when the one before ends; links not yet ended are not taken twice."""
    orders = src.table(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("item"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    done = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.max("l_shipdate").cast("timestamp").alias("ts"))
    adds = orders.select("chain", "ts", F.lit("add").alias("kind"), "item", F.concat(F.lit("h"), F.col("item") % 7).alias("link"))
    ends = orders.drop("ts").join(done, "item").select("chain", "ts", F.lit("end").alias("kind"), "item", F.lit(None).cast("string").alias("link"))
    rows = adds.unionByName(ends)
    groups = max(16, orders.count() // 10_000)
    return append.by_time(rows, lambda s: live.chains(s, groups=groups), _folder(spark), [{"chain": -1, "ts": 30 * 86_400, "kind": "end", "item": -1}])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def append_resumed(spark, d):
    """Rows appended batch by batch by a run that ends between the rows of a batch and its marker, and by the run that resumes it."""
    base = _folder(spark)
    rows = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows.repartition(5, "l_orderkey").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    table = append.AppendTable(spark, f"{base}/out", rows.schema)
    try:
        append.run(stream, table, f"{base}/checkpoint", lambda number: number == 1)
    except Exception as ended:
        if append.Interrupted.__name__ not in str(ended):
            raise
    append.run(stream, table, f"{base}/checkpoint")
    return table.read()


# ------------------------------------------------------------------ whole videos


def _slots_sql(step: int, first: str, where: str) -> str:
    return f"""WITH RECURSIVE {EV}, fr AS MATERIALIZED (SELECT DISTINCT video_id, pts_ms FROM ev WHERE {where}), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_ms) AS n FROM fr),
 f AS (SELECT video_id, 0::BIGINT AS n, NULL::BIGINT AS pts_ms, {first} AS slot, false AS hit FROM fr GROUP BY video_id UNION ALL
  SELECT o.video_id, o.n, o.pts_ms, CASE WHEN o.pts_ms < f.slot THEN f.slot WHEN f.slot + {step} <= o.pts_ms THEN o.pts_ms + {step} ELSE f.slot + {step} END, o.pts_ms >= f.slot FROM f JOIN o ON o.video_id = f.video_id AND o.n = f.n + 1)
 SELECT video_id, pts_ms FROM f WHERE hit"""


@query(_slots_sql(700, "min(pts_ms)", "true"))
def sampler_whole(spark, d):
    """The slot rule over each whole video, from its first frame on."""
    return sampler.samples(src.events(spark, d), 700)


@query(_slots_sql(1500, "20000::BIGINT", "pts_ms >= 20000 AND pts_ms < 1500000"))
def sampler_span(spark, d):
    """The slot rule from a given start to a given end."""
    return sampler.samples(src.events(spark, d), 1500, 20_000, 1_500_000)


# ------------------------------------------------------------------ whole tracks

_LENGTHS = f"{PCM}, le AS (SELECT track_id, count(*) AS n, CAST(ceil(count(*) / 1024e0) AS BIGINT) AS frames FROM pcm GROUP BY 1)"
#: Samples of frame ``f`` (j = 0 .. 4095) as they stand behind both reflections.
_WIDE = """y AS (SELECT *, (f + 2) * 1024 + j - 2048 AS y0, n + 1536 + (1536 + frames * 1024 - n) AS wide FROM fr, range(0, 4096) AS r(j)),
 z AS (SELECT *, CASE WHEN y0 < 0 THEN -y0 WHEN y0 >= wide THEN 2 * (wide - 1) - y0 ELSE y0 END - 1536 AS i0 FROM y),
 sa AS (SELECT z.track_id, z.f, z.j, pcm.l * (0.5e0 - 0.5e0 * cos(2 * pi() * j / 4096)) AS x FROM z JOIN pcm ON pcm.track_id = z.track_id AND pcm.i = CASE WHEN i0 < 0 THEN -i0 WHEN i0 >= n THEN 2 * (n - 1) - i0 ELSE i0 END)"""


@query(f"""WITH {_LENGTHS}, fr AS (SELECT track_id, n, frames, f FROM le, (VALUES (0), (1), (7), (8), (frames - 2), (frames - 1)) AS v(f) WHERE f >= 0 AND f < frames AND n > 2600 GROUP BY ALL), {_WIDE}
 SELECT track_id, f AS frame, k AS bin, round(sum(x * cos(2 * pi() * k * j / 4096)) / 64, 6) + 0e0 AS re, round(-sum(x * sin(2 * pi() * k * j / 4096)) / 64, 6) + 0e0 AS im FROM sa, (VALUES (1), (100), (2047)) AS b(k) GROUP BY 1, 2, 3""")
def stft_bins(spark, d):
    """Three bins of the first and last frames of each track and of frames on both sides of a block's end, of the whole-track transform at 4096 / 1024."""
    pcm = _pcm(spark, d)
    lengths = pcm.groupBy(F.col("track_id").alias("t")).agg(F.count("*").alias("n"))
    found = spectra.spectra(pcm, "track_id", "l", block=8).join(F.broadcast(lengths), F.col("track_id") == F.col("t")).where("n > 2600 AND (frame IN (0, 1, 7, 8) OR frame >= ceil(n / 1024) - 2)")
    bins = found.select("track_id", "frame", "re", "im", F.explode(F.array(F.lit(1), F.lit(100), F.lit(2047))).alias("bin"))
    return bins.select("track_id", "frame", "bin", *[(F.round(F.get(c, F.col("bin")), 6) + 0.0).alias(c) for c in ("re", "im")])


@query(f"""WITH {_LENGTHS}, pos AS (SELECT track_id, n, frames, i, l, i + 1536 + 2048 AS p FROM pcm JOIN le USING (track_id) WHERE i % 512 < 2 AND n > 2600),
 co AS (SELECT pos.track_id, pos.i, pos.l, g, p - g * 1024 AS j, frames, n, 0.5e0 - 0.5e0 * cos(2 * pi() * (p - g * 1024) / 4096) AS w FROM pos, range(0, 100000) AS r(g) WHERE g < frames + 4 AND g * 1024 <= p AND p < g * 1024 + 4096),
 fr AS (SELECT DISTINCT track_id, n, frames, g - 2 AS f FROM co WHERE g >= 2 AND g < frames + 2), {_WIDE},
 ny AS (SELECT track_id, f, sum(CASE WHEN j % 2 = 0 THEN x ELSE -x END) AS s FROM sa GROUP BY 1, 2)
 SELECT co.track_id, co.i, round((sum(CASE WHEN s IS NULL THEN 0 ELSE l * w * w - w * CASE WHEN j % 2 = 0 THEN s ELSE -s END / 4096 END)) / (sum(w * w) + 1e-8), 6) + 0e0 AS x FROM co LEFT JOIN ny ON ny.track_id = co.track_id AND ny.f = co.g - 2 GROUP BY 1, 2""")
def stft_inverse(spark, d):
    """Samples back from all frames of each track. They are the track's but for the Nyquist bin, which the frames leave out."""
    pcm = _pcm(spark, d)
    lengths = pcm.groupBy("track_id").agg(F.count("*").alias("length"))
    back = spectra.waves(spectra.spectra(pcm, "track_id", "l", block=8), lengths, "track_id", block=8)
    return back.join(F.broadcast(lengths.where("length > 2600")), "track_id").where("i % 512 < 2").select("track_id", "i", (F.round("x", 6) + 0.0).alias("x"))


_GATED = f"""{PCM}, fa AS (SELECT track_id, count(*) AS n, avg((l + r) / 2) AS mean, greatest(1e-8, coalesce(stddev_samp((l + r) / 2), 0)) AS std FROM pcm GROUP BY 1),
 sc AS (SELECT track_id, (i + 220) // 1080 AS k, CASE WHEN c = 0 THEN 0.3e0 WHEN c < 8 THEN 0.05e0 ELSE 0e0 END AS score FROM (SELECT track_id, (i + 220) // 1080 * 1080 - 220 AS i, count(*) FILTER (WHERE l > 0.5) % 23 AS c FROM pcm GROUP BY ALL)),
 se AS (SELECT a.track_id, a.k, max(CASE WHEN abs(b.k - a.k) <= 1 THEN b.score END) >= 0.15 OR (any_value(a.score) >= 0.02 AND max(b.score) >= 0.15) AS music FROM sc a JOIN sc b ON b.track_id = a.track_id AND b.k BETWEEN a.k - 2 AND a.k + 2 GROUP BY 1, 2),
 ov AS (SELECT pcm.track_id, i, l, r, k, music, i + 220 - k * 1080 AS j, least(i + 221 - k * 1080, 1200 - (i + 220 - k * 1080)) / 600e0 AS g FROM pcm JOIN se ON se.track_id = pcm.track_id AND (k = (i + 220) // 1080 OR k = (i + 220) // 1080 - 1) WHERE i + 220 - k * 1080 < 1200),
 su AS (SELECT track_id, i, sum(g * CASE WHEN music THEN -(l - mean) / std ELSE (l - mean) / std END) / sum(g) * any_value(std) + any_value(mean) AS x, sum(g * CASE WHEN music THEN -(r - mean) / std ELSE (r - mean) / std END) / sum(g) * any_value(std) + any_value(mean) AS y FROM ov JOIN fa USING (track_id) GROUP BY 1, 2)"""


@query(f"WITH {_GATED} SELECT track_id, i, round({_CLIP.format('x')}, 6) + 0e0 AS l, round({_CLIP.format('y')}, 6) + 0e0 AS r FROM su")
def stream_separator(spark, d):
    """A model that turns the sound over, run only where the gate says music, as one stream of blocks; passed-on chunks keep their sound."""
    pcm = _pcm(spark, d).withColumn("block", F.floor((F.col("i") + 220) / 1080))
    facts = pcm.groupBy("track_id").agg(F.count("*").alias("n"), F.avg((F.col("l") + F.col("r")) / 2).alias("mean"), F.greatest(F.lit(1e-8), F.coalesce(F.stddev_samp((F.col("l") + F.col("r")) / 2), F.lit(0.0))).alias("std"))
    loud = F.count_if(F.col("l") > 0.5) % 23
    samples = F.sort_array(F.collect_list(F.struct("i", F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))))
    blocks = pcm.groupBy("track_id", "block").agg(samples.alias("x"), F.when(loud == 0, 0.3).when(loud < 8, 0.05).otherwise(0.0).alias("score"))
    rows = blocks.join(F.broadcast(facts), "track_id").select("track_id", F.timestamp_millis(F.col("block") * 1000 + DAY).alias("ts"), "block", "score", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", "mean", "std")
    out = append.by_time(rows, lambda s: separate.separated(s, lambda wave: -wave, 1200, 1080, 220, origin=DAY), _folder(spark), [{"track_id": "~", "ts": 3600}])
    return out.select("track_id", "i", *[(F.round(c, 6) + 0.0).alias(c) for c in "lr"])
