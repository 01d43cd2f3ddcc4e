"""Further registered queries: probes, tolerant reads, small rules, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwise.functions import scalar as S
from spanwise.operators import gate
from spanwise.plans.catalogue import EV, FACE, GATE, JOBS, MUSIC, ORACLES, PCM, _music, _pcm, query
from spanwise.sources import fixtures as src


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) WHEN o_orderkey % 2 = 0 THEN o_custkey * 1234567 // 1000 ELSE 0 END AS duration_ms, (((o_orderkey * 90 - 720) % 360) + 360) % 360 AS rotation, CASE WHEN o_orderkey % 4 = 0 THEN 30e0 ELSE o_orderkey % 60 + 0e0 END AS fps, CASE WHEN o_orderkey % 5 = 0 THEN 1920 ELSE o_custkey % 700 + 1 END AS width FROM orders")
def probe_defaults(spark, d):
    """Duration from the first source that knows it, rotation in [0, 360), frame rate 30 if absent, cropped width."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    known = F.when(key % 3 != 0, F.floor("o_totalprice").cast("long"))
    track_us = F.when(key % 2 == 0, cust * 1234567)
    left, right = F.when(key % 5 != 0, F.lit(0)), F.when(key % 5 != 0, cust % 700)
    return src.table(spark, d, "orders").select(
        key.alias("id"), F.coalesce(known, F.floor(track_us / 1000), F.lit(0)).alias("duration_ms"), F.pmod(key * 90 - 720, F.lit(360)).alias("rotation"),
        F.coalesce(F.when(key % 4 != 0, (key % 60).cast("double")), F.lit(30.0)).alias("fps"), F.coalesce(right - left + 1, F.lit(1920)).alias("width"),
    )


_MIME = "['video/avc', 'audio/mp4a-latm', 'audio/ac3', 'text/vtt'][(l_partkey % 4 + 1)::INT]"


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, {_MIME} AS mime FROM lineitem) SELECT l_orderkey, min(l_linenumber) FILTER (WHERE starts_with(mime, 'video/')) AS video, min(l_linenumber) FILTER (WHERE starts_with(mime, 'audio/')) AS audio, CASE WHEN count(*) FILTER (WHERE starts_with(mime, 'audio/')) = 0 THEN 'none' WHEN bool_or(mime = 'audio/mp4a-latm') THEN 'copy' ELSE 'transcode' END AS plan FROM t GROUP BY 1")
def first_tracks(spark, d):
    """First track of each kind, and whether the sound can be copied."""
    mime = F.element_at(F.array(*[F.lit(m) for m in ("video/avc", "audio/mp4a-latm", "audio/ac3", "text/vtt")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    t = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mime.alias("mime"))
    first = lambda p: F.min(F.when(F.col("mime").startswith(p), F.col("l_linenumber")))
    sound = F.count_if(F.col("mime").startswith("audio/"))
    return t.groupBy("l_orderkey").agg(first("video/").alias("video"), first("audio/").alias("audio"), F.when(sound == 0, "none").when(F.bool_or(F.col("mime").isin(*S.MUXABLE)), "copy").otherwise("transcode").alias("plan"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN id % 11 = 0 OR id % 7 = 0 THEN 'FAILED' ELSE state END AS state, CASE WHEN id % 11 <> 0 AND id % 2 = 0 THEN 55 ELSE 40 END AS strictness, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN 'everyone' ELSE 'none' END AS who FROM ops")
def queue_tolerant(spark, d):
    """Queue documents read back: broken ones and unknown states fail, absent keys take defaults, a legacy flag counts if the new key is missing."""
    j, i = src.jobs(spark, d), F.col("id")
    state = F.when(i % 7 == 0, "WARPED").otherwise(F.col("state"))
    doc = F.when(i % 11 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(state.alias("state"), F.when(i % 2 == 0, 55).alias("strictness"), (i % 3 == 0).alias("censor_women"))))
    x = F.from_json(doc, "state string, strictness int, who string, censor_women boolean")
    read = j.select("id", x.alias("x"))
    known = F.col("x.state").isin("PENDING_DOWNLOAD", "DOWNLOADING", "PENDING_FILTER", "FILTERING", "DONE", "FAILED")
    who = F.coalesce(S.who(F.col("x.who")), F.when(F.col("x.censor_women").isNotNull(), S.who_from_legacy(F.col("x.censor_women"))))
    return read.select("id", F.when(known, F.col("x.state")).otherwise("FAILED").alias("state"), F.coalesce("x.strictness", F.lit(40)).alias("strictness"), who.alias("who"))


@query("WITH x AS (SELECT p_partkey, p_size * 2 AS amount, 320 + p_size * 40 AS w, 240 + (p_partkey % 60) * 20 AS h FROM part), y AS (SELECT *, greatest(0.1e0, amount / 100e0 * 40e0 * (least(w, h) / 1080e0)) AS s FROM x), z AS (SELECT *, CASE WHEN s <= 4 THEN 1 WHEN s <= 8 THEN 2 WHEN s <= 16 THEN 4 ELSE 8 END AS down FROM y) SELECT p_partkey, round(s, 6) AS sigma, down, greatest(1, least(10, ceil(round(2.5e0 * s / down, 9))::INT)) AS radius FROM z")
def blur_plans(spark, d):
    plan = S.blur_plan(F.col("p_size") * 2, 320 + F.col("p_size") * 40, 240 + (F.col("p_partkey") % 60) * 20)
    return src.table(spark, d, "part").select("p_partkey", plan.alias("x")).select("p_partkey", "x.*")


@query("WITH r AS (SELECT unnest(range(1, 11)) AS radius), w AS (SELECT radius, i, exp(-(i * i) / (2e0 * (radius / 2.5e0) * (radius / 2.5e0))) AS v FROM r, (SELECT unnest(range(0, 11)) AS i) WHERE i <= radius), t AS (SELECT radius, 2 * sum(v) - 1 AS s FROM w GROUP BY 1) SELECT radius, i, round(v / s, 9) AS weight FROM w JOIN t USING (radius)")
def gaussian_kernels(spark, d):
    k = spark.range(1, 11).select(F.col("id").alias("radius"), F.posexplode(S.gaussian(F.col("id") / 2.5, F.col("id").cast("int"))).alias("i", "v"))
    return k.select("radius", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("weight"))


@query(f"WITH {JOBS}, n AS (SELECT id, split_part(url, '/', 4) || '.' || id || '.tar.mp4' AS name, source_bytes AS b, duration_ms AS ms FROM jobs) SELECT id, regexp_replace(name, '\\.[^.]*$', '') || '-clean-' || id || '.mp4' AS output, CASE WHEN b >= 1000000000 THEN printf('%.1f GB', round(b / 1e9, 1)) ELSE (b // 1000000) || ' MB' END AS size, CASE WHEN id % 100 >= 3 THEN ms * (100 - id % 100) // (id % 100) ELSE 0 END AS live_eta FROM n")
def names_and_sizes(spark, d):
    name = F.concat(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("."), "id", F.lit(".tar.mp4"))
    return src.jobs(spark, d).select("id", F.concat(F.regexp_replace(name, "\\.[^.]*$", ""), F.lit("-clean-"), "id", F.lit(".mp4")).alias("output"), S.size_text(F.col("source_bytes")).alias("size"), S.live_eta_ms(F.col("duration_ms"), F.col("id") % 100).alias("live_eta"))


@query("WITH x AS (SELECT o_orderkey AS id, unnest(string_split(o_orderkey || '-' || (o_orderkey + 9) || ',x,' || o_custkey || ' - ' || (o_custkey * 2) || ',5', ',')) AS p FROM orders) SELECT id, TRY_CAST(trim(split_part(p, '-', 1)) AS BIGINT) AS s, TRY_CAST(trim(split_part(p, '-', 2)) AS BIGINT) AS e FROM x WHERE TRY_CAST(trim(split_part(p, '-', 1)) AS BIGINT) IS NOT NULL AND TRY_CAST(nullif(trim(split_part(p, '-', 2)), '') AS BIGINT) IS NOT NULL")
def span_strings(spark, d):
    text = F.concat(F.col("o_orderkey"), F.lit("-"), F.col("o_orderkey") + 9, F.lit(",x,"), F.col("o_custkey"), F.lit(" - "), F.col("o_custkey") * 2, F.lit(",5"))
    return src.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(S.span_list(text)).alias("x")).select("id", "x.s", "x.e")


@query("SELECT s AS segment, k, s * 64300 + k * 200 AS pts_ms, 'eval' AS use FROM (SELECT unnest(range(0, 10)) AS s), (SELECT unnest(range(0, 36)) AS k) UNION ALL SELECT s, k, s * 64300 + 7200 + k * 4000, 'calib' FROM (SELECT unnest(range(0, 10)) AS s), (SELECT unnest(range(0, 10)) AS k)")
def eval_windows(spark, d):
    """Evaluation frames every 200 ms and calibration frames every 4 s of ten segments, disjoint."""
    s = spark.range(10).select(F.col("id").alias("segment"))
    kinds = F.concat(F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: F.struct(k.alias("k"), (k * 200).alias("off"), F.lit("eval").alias("use"))), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(k.alias("k"), (7200 + k * 4000).alias("off"), F.lit("calib").alias("use"))))
    return s.withColumn("x", F.explode(kinds)).select("segment", F.col("x.k").cast("long").alias("k"), (F.col("segment") * 64300 + F.col("x.off")).alias("pts_ms"), "x.use")


@query(f"WITH {JOBS} SELECT CASE WHEN id % 4 = 0 OR id % 9000 < 6656 THEN 'sequential' ELSE 'concurrent' END AS schedule, CASE WHEN id % 5 >= 3 THEN 2000 WHEN id % 5 = 2 THEN 500 ELSE 0 END AS pause_ms, count(*) AS n FROM jobs GROUP BY ALL")
def schedules(spark, d):
    i = F.col("id")
    return src.jobs(spark, d).groupBy(S.schedule(i % 4 == 0, i % 9000).alias("schedule"), S.thermal_pause_ms(i % 5).alias("pause_ms")).agg(F.count("*").alias("n"))


@query(f"WITH {PCM}, x AS (SELECT track_id, l, floor(l * 32767 + 0.5e0) / 32767e0 AS q FROM pcm) SELECT track_id, round(10 * log10(sum(l * l) / sum((l - q) * (l - q))), 4) AS snr_db, round(max(abs(l)), 9) AS peak FROM x GROUP BY 1")
def snr(spark, d):
    """Signal-to-noise ratio of the 16-bit form, and the peak."""
    x = _pcm(spark, d).select("track_id", "l", (F.floor(F.col("l") * 32767 + 0.5) / 32767.0).alias("q"))
    noise = F.sum((F.col("l") - F.col("q")) * (F.col("l") - F.col("q")))
    return x.groupBy("track_id").agg(F.round(10 * F.log10(F.sum(F.col("l") * F.col("l")) / noise), 4).alias("snr_db"), F.round(F.max(F.abs("l")), 9).alias("peak"))


@query(f"WITH {EV}, x AS (SELECT user_id, event_id, pts_ms, lead(pts_ms) OVER (PARTITION BY user_id ORDER BY pts_ms, event_id) AS nx FROM ev) SELECT user_id, event_id, nx - pts_ms AS took FROM x WHERE nx IS NOT NULL")
def stage_durations(spark, d):
    nx = F.lead("pts_ms").over(Window.partitionBy("user_id").orderBy("pts_ms", "event_id"))
    return src.events(spark, d).withColumn("nx", nx).where("nx is not null").select("user_id", "event_id", (F.col("nx") - F.col("pts_ms")).alias("took"))


def _floored(music):
    return music.select("video_id", "chunk", F.when(F.col("score") < F.lit(0.001).cast("float"), F.lit(0).cast("float")).otherwise(F.col("score")).alias("floored"))


@query(f"WITH {MUSIC} SELECT video_id, chunk, CASE WHEN score < 0.001::FLOAT THEN 0::FLOAT ELSE score END AS floored FROM music")
def silence_floor(spark, d):
    return _floored(_music(spark, d))


@query(ORACLES["silence_floor"].replace(" WHERE chunk % 3 = 0", ""))
def silence_floor_all(spark, d):
    return _floored(_music(spark, d))


@query("WITH x AS (SELECT vec_id, greatest(list_max(embedding[1:20]), list_max(embedding[41:64])) AS m FROM embeddings) SELECT vec_id, round(m::DOUBLE, 6) AS music FROM x")
def class_range_max(spark, d):
    """Best score over two class ranges."""
    e = src.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.greatest(F.array_max(F.slice("embedding", 1, 20)), F.array_max(F.slice("embedding", 41, 24))).cast("double"), 6).alias("music"))


@query("SELECT l_orderkey, round(sum(l_quantity) FILTER (WHERE l_returnflag IN ('A', 'N')), 6) AS kept, max(l_extendedprice) AS largest, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS largest_part FROM lineitem GROUP BY 1")
def kept_stems(spark, d):
    """Sum over kept stems, and the largest file of each folder."""
    kept = F.sum(F.when(F.col("l_returnflag").isin("A", "N"), F.col("l_quantity")))
    return src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(kept, 6).alias("kept"), F.max("l_extendedprice").alias("largest"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("largest_part"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS codec, l_linestatus AS rate, first_value(l_returnflag) OVER w AS c0, first_value(l_linestatus) OVER w AS r0 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) SELECT l_orderkey, count(*) FILTER (WHERE codec <> c0 OR rate <> r0) AS misfits FROM x GROUP BY 1")
def part_compatibility(spark, d):
    """Parts whose configuration differs from the first part's."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = src.table(spark, d, "lineitem").select("l_orderkey", ((F.col("l_returnflag") != F.first("l_returnflag").over(w)) | (F.col("l_linestatus") != F.first("l_linestatus").over(w))).alias("off"))
    return x.groupBy("l_orderkey").agg(F.count_if("off").alias("misfits"))


@query(f"WITH {JOBS} SELECT a.id FROM jobs a WHERE a.state NOT IN ('DONE', 'FAILED') AND EXISTS (SELECT 1 FROM jobs c WHERE c.owner = a.owner AND c.id % 97 = 0 AND c.id <> a.id AND (c.state LIKE '%DOWNLOAD%') = (a.state LIKE '%DOWNLOAD%'))")
def chain_survivors(spark, d):
    """Waiting jobs on the same side of the pipeline as a cancelled one of the same owner."""
    side = F.col("state").contains("DOWNLOAD")
    j = src.jobs(spark, d).select("id", "owner", "state", side.alias("side"))
    cut = j.where("id % 97 = 0").select(F.col("owner").alias("_o"), F.col("side").alias("_s"), F.col("id").alias("_i"))
    live = j.where(~F.col("state").isin(*S.TERMINAL))
    return live.join(cut, (F.col("owner") == F.col("_o")) & (F.col("side") == F.col("_s")) & (F.col("id") != F.col("_i")), "left_semi").select("id")


@query(f"WITH {FACE} SELECT video_id, count(*) AS faces, count(*) FILTER (WHERE tracking_id IS NULL) AS untracked, count(DISTINCT tracking_id) AS ids, max(px) AS largest FROM face GROUP BY 1")
def face_counters(spark, d):
    return src.faces(spark, d).groupBy("video_id").agg(F.count("*").alias("faces"), F.count_if(F.col("tracking_id").isNull()).alias("untracked"), F.countDistinct("tracking_id").alias("ids"), F.max("px").alias("largest"))


@query(f"WITH {GATE} SELECT video_id, event_id, CASE greatest(drawings, hentai, neutral, porn, sexy) WHEN drawings THEN 'drawings' WHEN hentai THEN 'hentai' WHEN neutral THEN 'neutral' WHEN porn THEN 'porn' ELSE 'sexy' END AS top FROM gate")
def gate_argmax(spark, d):
    best = F.greatest(*gate.THRESHOLDS)
    top = F.lit(None)
    for name in reversed(list(gate.THRESHOLDS)):
        top = F.when(F.col(name) == best, F.lit(name)).otherwise(top)
    return src.gate_scores(spark, d).select("video_id", "event_id", top.alias("top"))
