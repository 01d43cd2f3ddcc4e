"""Registered queries. Each is a composition of operators over the driver's tables, with a DuckDB
equivalent that is written another way (plain windows, recursive or correlated SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.functions import scalar as S
from spanwise.operators import audio, gate, intervals, planning, tracks
from spanwise.operators.numbering import changes, numbered
from spanwise.sources import fixtures as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT event_id, event_type AS video_id, user_id, (epoch_us(ts) - 1704067200000000) // 1000000 AS pts_ms, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
_TOTAL = " + ".join(f"abs(embedding[{i}]::DOUBLE)" for i in range(1, 6))
GATE = EV + ", vn AS (SELECT count(*) AS n FROM embeddings), vs AS (SELECT vec_id, " + ", ".join(f"CAST(abs(embedding[{i}]::DOUBLE) / ({_TOTAL}) AS FLOAT) AS {c}" for i, c in enumerate(src.CLASSES, 1)) + " FROM embeddings), gate AS (SELECT event_id, video_id, pts_ms, drawings, hentai, neutral, porn, sexy FROM ev, vn JOIN vs ON vec_id = event_id % n), dur AS (SELECT video_id, max(pts_ms) AS d FROM ev GROUP BY 1)"


def _margin(c: str, s: str) -> str:
    low, high, _ = gate.THRESHOLDS[c]
    return f"({c} - ({low}::FLOAT + CAST(({high}::FLOAT - {low}::FLOAT) * {s}::FLOAT / 100::FLOAT AS FLOAT)))"


def _fired(s: str) -> str:
    bad, good = (f"greatest({', '.join(_margin(c, s) for c, t in gate.THRESHOLDS.items() if t[2] is x)})" for x in (True, False))
    return f"({bad} >= 0 AND {bad} > {good})"


def _merged(source: str, bridge: int, out: str) -> str:
    """CTEs: ``source`` (video_id, s, e) merged into ``out``."""
    return f"""{out}_1 AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source}),
    {out}_2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {bridge} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {out}_1),
    {out} AS (SELECT video_id, min(s) AS s, max(e) AS e FROM {out}_2 GROUP BY video_id, g)"""


def _intervals(s: int, out: str) -> str:
    return f"{out}_f AS (SELECT video_id, greatest(0, pts_ms - 500) AS s, least(d, pts_ms + 1500) AS e FROM gate JOIN dur USING (video_id) WHERE {_fired(str(s))}), " + _merged(f"{out}_f", 1, out)


FACE = EV + """, face AS (SELECT event_id, video_id, ((pts_ms // 100) // 100) * 100 AS pts_ms, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS tracking_id,
    k / 200e0 AS l, (event_id % 50) / 100e0 AS t, k / 200e0 + 0.1e0 + (event_id % 7) / 50e0 AS r, (event_id % 50) / 100e0 + 0.1e0 + (event_id % 5) / 50e0 AS b,
    20 + event_id % 300 AS px, (event_id * 7919) % 3 - 1 AS vote FROM ev)"""
TRACK = FACE + """, fr AS (SELECT DISTINCT video_id, pts_ms FROM face),
    la AS (SELECT *, lag(pts_ms) OVER (PARTITION BY video_id, tracking_id ORDER BY pts_ms, event_id) AS p FROM face WHERE tracking_id IS NOT NULL),
    nf AS (SELECT la.event_id, min(fr.pts_ms) AS f FROM la JOIN fr ON fr.video_id = la.video_id AND fr.pts_ms >= la.p + 2000 AND fr.pts_ms < la.pts_ms GROUP BY 1),
    se AS (SELECT la.* EXCLUDE (p), sum(CASE WHEN p IS NULL OR f IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, tracking_id ORDER BY pts_ms, la.event_id ROWS UNBOUNDED PRECEDING) AS n FROM la LEFT JOIN nf USING (event_id)),
    track AS (SELECT * EXCLUDE (n), 'id:' || tracking_id || ':' || n AS track_key FROM se UNION ALL SELECT *, 'one:' || event_id FROM face WHERE tracking_id IS NULL),
    span AS (SELECT video_id, track_key, greatest(0, min(pts_ms) - 50) AS start_ms, max(pts_ms) + 50 AS end_ms, count(*) AS n_keyframes FROM track GROUP BY 1, 2)"""
JOBS = """jobs AS (SELECT o_orderkey AS id, 'https://h' || (o_custkey % 40) || '.example.com/v/' || (o_orderkey % 500) AS url, CAST(floor(o_totalprice * 20) AS BIGINT) AS duration_ms, CAST(floor(o_totalprice * 1000) AS BIGINT) AS source_bytes,
    o_orderkey % 3 = 0 AS remove_music, ['none', 'women', ' Men ', 'bogus', ''][o_orderkey % 5 + 1] AS who_raw, o_orderdate AS added, o_custkey AS owner,
    CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'DONE' END WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'DOWNLOADING' ELSE 'FILTERING' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING_DOWNLOAD' ELSE 'PENDING_FILTER' END END AS state FROM orders),
    ops AS (SELECT *, CASE WHEN trim(who_raw) = '' THEN NULL WHEN lower(trim(who_raw)) IN ('none', 'everyone', 'women', 'men') THEN lower(trim(who_raw)) ELSE 'everyone' END AS who, coalesce(lower(trim(who_raw)) NOT IN ('none', ''), false) AS censor FROM jobs)"""
REL = """rel AS (SELECT p_partkey AS id, 'v' || (p_size // 10) || '.' || (p_size % 10) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-beta' || (p_partkey % 12) ELSE '-rc' || (p_partkey % 4) END AS tag, p_partkey % 11 = 0 AS draft, p_partkey % 3 <> 0 AS prerelease FROM part),
    ver AS (SELECT *, CAST(split_part(split_part(substr(tag, 2), '-', 1), '.', 1) AS INT) AS n0, CAST(split_part(split_part(substr(tag, 2), '-', 1), '.', 2) AS INT) AS n1, NOT contains(tag, '-') AS is_release, regexp_extract(tag, '-([a-z]*)', 1) AS letters, coalesce(TRY_CAST(regexp_extract(tag, '-[a-z]*([0-9]+)', 1) AS INT), 0) AS num FROM rel)"""
PCM = """pcm AS (SELECT l_returnflag AS track_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, (l_quantity - 25) / 25 AS l, (l_tax * 100 - 4) / 4 + 0e0 AS r FROM lineitem)"""
MUSIC = EV + ", music AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pts_ms, event_id) - 1 AS chunk, CAST(value / 500 AS FLOAT) AS score FROM ev)"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# ------------------------------------------------------------------ gate and intervals


def _durations(spark, d):
    return src.events(spark, d).groupBy("video_id").agg(F.max("pts_ms").alias("duration_ms"))


def _gate_intervals(spark, d, strictness=40):
    return gate.hysteresis(gate.firings(src.gate_scores(spark, d), strictness), _durations(spark, d))


def _tracked(spark, d):
    return tracks.sessions(src.faces(spark, d))


def _track_intervals(spark, d):
    return tracks.spans(_tracked(spark, d)).select("video_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


@query("SELECT s AS strictness, c AS class, round((t0::FLOAT + CAST((t1::FLOAT - t0::FLOAT) * greatest(0, least(100, s))::FLOAT / 100::FLOAT AS FLOAT))::DOUBLE, 6) AS threshold FROM (SELECT unnest(range(-20, 121, 5)) AS s), (VALUES " + ", ".join(f"('{c}', {v[0]}, {v[1]})" for c, v in gate.THRESHOLDS.items()) + ") AS v(c, t0, t1)")
def gate_thresholds(spark, d):
    s = spark.range(-20, 121, 5).select(F.col("id").cast("int").alias("strictness"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.round(gate.threshold(c, F.col("strictness")).cast("double"), 6).alias("threshold")) for c in gate.THRESHOLDS]))
    return s.withColumn("x", rows).select(F.col("strictness").cast("long"), "x.class", "x.threshold")


@query(f"WITH {GATE} SELECT video_id, event_id, pts_ms FROM gate WHERE {_fired('40')}")
def gate_fires(spark, d):
    return gate.firings(src.gate_scores(spark, d)).select("video_id", "event_id", "pts_ms")


@query(f"WITH {GATE} SELECT s AS strictness, count(*) AS n_frames, count(*) FILTER (WHERE {_fired('s')}) AS n_fired FROM gate, (SELECT unnest([0, 20, 40, 60, 80, 100]) AS s) GROUP BY s")
def gate_fire_rate_by_strictness(spark, d):
    return src.gate_scores(spark, d).withColumn("strictness", F.explode(F.array(*[F.lit(s) for s in (0, 20, 40, 60, 80, 100)]))).groupBy("strictness").agg(F.count("*").alias("n_frames"), F.count_if(gate.fires(F.col("strictness"))).alias("n_fired"))


@query(f"WITH {GATE}, {_intervals(40, 'iv')} SELECT video_id, s, e FROM iv")
def gate_intervals(spark, d):
    return _gate_intervals(spark, d)


@query(f"WITH {GATE}, {_intervals(100, 'iv')} SELECT video_id, count(*) AS n_intervals, sum(e - s + 1)::BIGINT AS covered FROM iv GROUP BY 1")
def gate_coverage(spark, d):
    return intervals.coverage(_gate_intervals(spark, d, 100), ["video_id"])


def _bridged(events):
    return intervals.merge(events.select("video_id", F.col("pts_ms").alias("s"), (F.col("pts_ms") + F.col("k")).alias("e")), 400, ["video_id"])


@query(f"WITH {EV}, x AS (SELECT video_id, pts_ms AS s, pts_ms + k AS e FROM ev), {_merged('x', 400, 'm')} SELECT * FROM m")
def interval_bridge_merge(spark, d):
    return _bridged(src.events(spark, d))


@query(ORACLES["interval_bridge_merge"].replace(" WHERE event_id % 7 = 0", ""))
def interval_bridge_merge_all(spark, d):
    return _bridged(src.events(spark, d))


@query(f"WITH {GATE}, {_intervals(40, 'iv')}, {TRACK[len(EV) + 2:]}, u AS (SELECT video_id, s, e FROM iv UNION ALL SELECT video_id, start_ms, end_ms FROM span), {_merged('u', 400, 'm')} SELECT * FROM m WHERE e - s >= 500")
def interval_promote_floor(spark, d):
    both = _gate_intervals(spark, d).unionByName(_track_intervals(spark, d))
    return intervals.at_least(intervals.merge(both, 400, ["video_id"]), 500)


@query(f"""WITH {TRACK}, dl AS (SELECT video_id, start_ms AS t, 1 AS x FROM span UNION ALL SELECT video_id, end_ms + 1, -1 FROM span), st AS (SELECT video_id, t, sum(x) AS x FROM dl GROUP BY 1, 2),
 ac AS (SELECT *, sum(x) OVER (PARTITION BY video_id ORDER BY t) > 8 AS hot, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS nt FROM st),
 fl AS (SELECT *, CASE WHEN hot IS DISTINCT FROM lag(hot) OVER (PARTITION BY video_id ORDER BY t) THEN 1 ELSE 0 END AS f FROM ac), ru AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY t) AS g FROM fl)
 SELECT video_id, min(t) AS s, max(nt) - 1 AS e FROM ru WHERE hot GROUP BY video_id, g""")
def overlap_spans(spark, d):
    return intervals.overlaps(_track_intervals(spark, d), 8, ["video_id"])


_FRAMES = f"WITH {GATE}, {_intervals(40, 'iv')}, fr AS (SELECT DISTINCT video_id, pts_ms FROM ev)"


@query(f"{_FRAMES} SELECT * FROM fr WHERE EXISTS (SELECT 1 FROM iv WHERE iv.video_id = fr.video_id AND fr.pts_ms BETWEEN s AND e)")
def frames_full(spark, d):
    return intervals.points_in(src.events(spark, d).select("video_id", "pts_ms").distinct(), _gate_intervals(spark, d), ["video_id"], "pts_ms", "left_semi")


@query(f"{_FRAMES} SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.video_id = fr.video_id AND fr.pts_ms BETWEEN s AND e)")
def frames_not_full(spark, d):
    return intervals.points_in(src.events(spark, d).select("video_id", "pts_ms").distinct(), _gate_intervals(spark, d), ["video_id"], "pts_ms", "left_anti")


@query(f"WITH {GATE}, {_intervals(60, 'a')}, {_intervals(40, 'b')}, x AS (SELECT a.video_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.video_id = b.video_id AND a.s <= b.e AND b.s <= a.e), ca AS (SELECT video_id, sum(e - s + 1) AS c FROM a GROUP BY 1), cx AS (SELECT video_id, sum(e - s + 1) AS c FROM x GROUP BY 1) SELECT ca.video_id, ca.c::BIGINT AS reference_ms, coalesce(cx.c, 0)::BIGINT AS common_ms, round(coalesce(cx.c, 0) / ca.c, 9) AS recall FROM ca LEFT JOIN cx USING (video_id)")
def interval_recall(spark, d):
    a, b = _gate_intervals(spark, d, 60), _gate_intervals(spark, d, 40)
    common = intervals.coverage(intervals.intersections(a, b, ["video_id"]), ["video_id"]).select("video_id", F.col("covered").alias("_c"))
    c = F.coalesce("_c", F.lit(0))
    return intervals.coverage(a, ["video_id"]).join(common, "video_id", "left").select("video_id", F.col("covered").alias("reference_ms"), c.alias("common_ms"), F.round(c / F.col("covered"), 9).alias("recall"))


@query(f"WITH {GATE} SELECT video_id, count(*) FILTER (WHERE {_fired('40')} <> {_fired('60')}) AS flips, count(*) AS n, round(max(abs(porn::DOUBLE - sexy::DOUBLE)), 6) AS max_delta FROM gate GROUP BY 1")
def gate_flips(spark, d):
    return src.gate_scores(spark, d).groupBy("video_id").agg(F.count_if(gate.fires(F.lit(40)) != gate.fires(F.lit(60))).alias("flips"), F.count("*").alias("n"), F.round(F.max(F.abs(F.col("porn").cast("double") - F.col("sexy").cast("double"))), 6).alias("max_delta"))


# ------------------------------------------------------------------ tracks


@query(f"WITH {TRACK} SELECT video_id, track_key, start_ms, end_ms, n_keyframes FROM span")
def track_spans(spark, d):
    return tracks.spans(_tracked(spark, d))


@query(f"WITH {TRACK} SELECT video_id, event_id, track_key FROM track")
def track_sessions(spark, d):
    return _tracked(spark, d).select("video_id", "event_id", "track_key")


@query(f"""WITH {TRACK}, v1 AS (SELECT *, coalesce(max(px) OVER (PARTITION BY video_id, track_key ORDER BY pts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM track WHERE px >= 80 AND tracking_id IS NOT NULL),
 v2 AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_key ORDER BY pts_ms, event_id) AS n FROM v1 WHERE px > best), v3 AS (SELECT video_id, track_key, count(*) FILTER (WHERE vote = 1) AS male, count(*) FILTER (WHERE vote = -1) AS female, count(*) AS tried FROM v2 WHERE n <= 5 GROUP BY 1, 2),
 v4 AS (SELECT video_id, track_key, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(tried, 0) AS tried FROM span LEFT JOIN v3 USING (video_id, track_key))
 SELECT *, NOT (male > female) AS censor_women, NOT (female > male) AS censor_men, true AS censor_everyone, false AS censor_none FROM v4""")
def track_votes(spark, d):
    v = tracks.votes(_tracked(spark, d))
    return v.select("*", *[tracks.should_censor(F.col("female"), F.col("male"), F.lit(w)).alias(f"censor_{w}") for w in ("women", "men", "everyone", "none")])


@query(f"""WITH {GATE}, {_intervals(40, 'iv')}, {TRACK[len(EV) + 2:]}, op AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.video_id = fr.video_id AND fr.pts_ms BETWEEN s AND e)),
 hit AS (SELECT op.video_id, op.pts_ms AS ft, track_key FROM op JOIN span ON span.video_id = op.video_id AND op.pts_ms BETWEEN start_ms AND end_ms),
 fa AS (SELECT hit.video_id, hit.ft, hit.track_key, arg_max(struct_pack(p := k.pts_ms, l := k.l, t := k.t, r := k.r, b := k.b), struct_pack(a := k.pts_ms, b := k.event_id)) FILTER (WHERE k.pts_ms <= ft) AS p0,
   arg_min(struct_pack(p := k.pts_ms, l := k.l, t := k.t, r := k.r, b := k.b), struct_pack(a := k.pts_ms, b := k.event_id)) FILTER (WHERE k.pts_ms > ft) AS p1 FROM hit JOIN track k ON k.video_id = hit.video_id AND k.track_key = hit.track_key GROUP BY 1, 2, 3),
 pl AS (SELECT video_id, ft, track_key, {", ".join(f"floor((CASE WHEN p0 IS NULL THEN p1.{c} WHEN p1 IS NULL OR ft <= p0.p THEN p0.{c} ELSE p0.{c} + (p1.{c} - p0.{c}) * ((ft - p0.p) / (p1.p - p0.p)) END) * 1e6 + 0.5e0) / 1e6 AS {c}" for c in "ltrb")} FROM fa),
 rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, ft ORDER BY floor((r - l) * (b - t) * 1e9 + 0.5e0) DESC, track_key) AS rank FROM pl)
 SELECT video_id, ft AS pts_ms, track_key, l, t, r, b, rank FROM rk WHERE rank <= 8""")
def regions_at(spark, d):
    faces = src.faces(spark, d)
    return tracks.regions(faces, tracks.sessions(faces), _gate_intervals(spark, d))


_LOGIT = "lg AS (SELECT embedding[1]::DOUBLE AS f, embedding[2]::DOUBLE AS m, label % 2 AS truth FROM embeddings)"


@query(f"WITH {_LOGIT}, p AS (SELECT truth, 1 / (1 + exp(-(m - f))) AS p FROM lg), x AS (SELECT fl, truth, CASE WHEN greatest(p, 1 - p) < fl / 100e0 THEN 0 WHEN p >= 0.5 THEN 1 ELSE -1 END AS v FROM p, (SELECT unnest(range(50, 95, 5)) AS fl)) SELECT fl AS floor_pct, count(*) AS n, count(*) FILTER (WHERE v = 0) AS abstained, count(*) FILTER (WHERE v = 1 AND truth = 1) AS male_right, count(*) FILTER (WHERE v = -1 AND truth = 0) AS female_right, count(*) FILTER (WHERE v = 1 AND truth = 0) AS exposed FROM x GROUP BY fl")
def vote_floor_sweep(spark, d):
    rows = src.table(spark, d, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("f"), F.element_at("embedding", 2).cast("double").alias("m"), (F.col("label") % 2).alias("truth"))
    floors = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("floor_pct"), S.vote(F.col("f"), F.col("m"), x / 100).alias("v")) for x in range(50, 95, 5)]))
    x = rows.withColumn("x", floors).select("truth", "x.*")
    right = lambda v, t: F.count_if((F.col("v") == v) & (F.col("truth") == t))
    return x.groupBy("floor_pct").agg(F.count("*").alias("n"), F.count_if(F.col("v") == 0).alias("abstained"), right(1, 1).alias("male_right"), right(-1, 0).alias("female_right"), right(1, 0).alias("exposed"))


@query(f"WITH {FACE} SELECT CASE WHEN px < 40 THEN 'tiny' WHEN px < 80 THEN '40-80' WHEN px < 160 THEN '80-160' WHEN px < 320 THEN '160-320' ELSE '320+' END AS band, count(*) AS n, round(avg(CASE WHEN (vote = 1) = (event_id % 2 = 0) THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM face WHERE vote <> 0 GROUP BY 1")
def vote_size_bands(spark, d):
    px = F.col("px")
    band = F.when(px < 40, "tiny").when(px < 80, "40-80").when(px < 160, "80-160").when(px < 320, "160-320").otherwise("320+")
    return src.faces(spark, d).where("vote <> 0").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(((F.col("vote") == 1) == (F.col("event_id") % 2 == 0)).cast("double")), 9).alias("accuracy"))


@query(f"WITH {FACE}, d AS (SELECT event_id, unnest([0, 90, 180, 270, -270, 450, 45]) AS deg, l, t, r, b FROM face) SELECT event_id, deg, " + ", ".join(f"round(CASE ((deg % 360) + 360) % 360 WHEN 90 THEN {a} WHEN 180 THEN {b} WHEN 270 THEN {c} ELSE {n} END, 9) AS {n}" for n, a, b, c in (("l", "t", "1 - r", "1 - b"), ("t", "1 - r", "1 - b", "l"), ("r", "b", "1 - l", "1 - t"), ("b", "1 - l", "1 - t", "r"))) + " FROM d")
def rect_rotation(spark, d):
    rows = src.faces(spark, d).withColumn("deg", F.explode(F.array(*[F.lit(x) for x in (0, 90, 180, 270, -270, 450, 45)])))
    return rows.select("event_id", "deg", S.rotated(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.col("deg")).alias("q")).select("event_id", "deg", *[F.round(f"q.{c}", 9).alias(c) for c in "ltrb"])


@query(f"WITH {FACE} SELECT event_id, round(greatest(0e0, l - (r - l) * 0.25e0), 9) AS l, round(greatest(0e0, t - (b - t) * 0.25e0), 9) AS t, round(least(1e0, r + (r - l) * 0.25e0), 9) AS r, round(least(1e0, b + (b - t) * 0.25e0), 9) AS b FROM face")
def rect_padding(spark, d):
    (left, right), (top, bottom) = S.padded(F.col("l"), F.col("r")), S.padded(F.col("t"), F.col("b"))
    return src.faces(spark, d).select("event_id", *[F.round(c, 9).alias(n) for n, c in (("l", left), ("t", top), ("r", right), ("b", bottom))])


# ------------------------------------------------------------------ sampling and plans


@query(f"WITH {EV} SELECT video_id, event_id, pts_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_ms, event_id) - 1 AS n FROM ev) WHERE n % 2 = 0")
def frame_stride(spark, d):
    return planning.strided(src.events(spark, d), 2).select("video_id", "event_id", "pts_ms")


@query(f"""WITH RECURSIVE {EV}, fr AS (SELECT DISTINCT video_id, pts_ms, pts_ms // 300000 AS w FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY video_id, w ORDER BY pts_ms) AS n FROM fr),
 f AS (SELECT video_id, w, 0::BIGINT AS n, NULL::BIGINT AS pts_ms, w * 300000 AS slot, false AS hit FROM (SELECT DISTINCT video_id, w FROM o) UNION ALL
  SELECT o.video_id, o.w, o.n, o.pts_ms, CASE WHEN o.pts_ms < f.slot THEN f.slot WHEN f.slot + 700 <= o.pts_ms THEN o.pts_ms + 700 ELSE f.slot + 700 END, o.pts_ms >= f.slot FROM f JOIN o ON o.video_id = f.video_id AND o.w = f.w AND o.n = f.n + 1)
 SELECT video_id, pts_ms FROM f WHERE hit""")
def slot_sampler(spark, d):
    return planning.slot_samples(src.events(spark, d).select("video_id", "pts_ms").distinct(), 700)


@query(ORACLES["slot_sampler"].replace(" WHERE pts_ms % 3 <> 1", ""))
def slot_sampler_all(spark, d):
    return planning.slot_samples(src.events(spark, d).select("video_id", "pts_ms").distinct(), 700)


_PLAN = JOBS + """, vd AS (SELECT id AS video_id, duration_ms FROM jobs WHERE duration_ms > 300000 AND duration_ms >= 1800000),
 cu AS (SELECT video_id, duration_ms, 0::BIGINT AS c FROM vd UNION SELECT video_id, duration_ms, duration_ms FROM vd UNION SELECT video_id, duration_ms, greatest(0, least(duration_ms, i * 300000 + 2137)) FROM (SELECT *, unnest(range(1, CAST((duration_ms + 299999) // 300000 AS BIGINT))) AS i FROM vd)),
 pl AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY c) - 1 AS idx, c AS start_ms, lead(c) OVER (PARTITION BY video_id ORDER BY c) AS end_ms FROM cu)"""


def _planned(videos):
    return planning.segment_plan(videos, lambda ms: ms + 2137)


def _plan(spark, d):
    return _planned(src.jobs(spark, d).select(F.col("id").alias("video_id"), "duration_ms"))


@query(f"WITH {_PLAN} SELECT * FROM pl WHERE end_ms IS NOT NULL")
def segment_plan(spark, d):
    return _plan(spark, d).withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {_PLAN} SELECT * FROM pl WHERE end_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = video_id AND l_linenumber = idx)")
def segment_resume(spark, d):
    done = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("idx"))
    return planning.pending(_plan(spark, d), done).withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {EV}, x AS (SELECT video_id, pts_ms, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS is_audio, event_id FROM ev) SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_ms, is_audio, event_id) AS place FROM x")
def mux_interleave(spark, d):
    ev = src.events(spark, d).select("video_id", "pts_ms", "event_id")
    video, sound = ev.where("event_id % 3 <> 0").withColumn("is_audio", F.lit(0)), ev.where("event_id % 3 = 0").withColumn("is_audio", F.lit(1))
    both = numbered(video.unionByName(sound), ["video_id"], F.floor(F.col("pts_ms") / 10_000), ["pts_ms", "is_audio", "event_id"], "place")
    return both.withColumn("place", F.col("place") + 1)


@query(f"WITH {EV}, p AS (SELECT event_id, video_id, pts_ms // 60000 AS part, pts_ms % 60000 AS local FROM ev), o AS (SELECT DISTINCT part, part * 60000 + 41 AS start_ms FROM p) SELECT event_id, video_id, (local + start_ms) * 1000 AS pts_us FROM p JOIN o USING (part)")
def concat_offsets(spark, d):
    parts = src.events(spark, d).select("event_id", "video_id", F.floor(F.col("pts_ms") / 60000).alias("part"), (F.col("pts_ms") % 60000).alias("local"))
    starts = parts.select("part").distinct().withColumn("start_ms", F.col("part") * 60000 + 41)
    return parts.join(starts, "part").select("event_id", "video_id", ((F.col("local") + F.col("start_ms")) * 1000).alias("pts_us"))


# ------------------------------------------------------------------ audio


def _pcm(spark, d):
    """``track_id, i, l, r``: one sample per line item, numbered per track by buckets of orders."""
    rows = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("track_id"), ((F.col("l_quantity") - 25) / 25).alias("l"), ((F.col("l_tax") * 100 - 4) / 4 + 0.0).alias("r"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return numbered(rows, ["track_id"], F.floor(F.col("l_orderkey") / 4096), order, "i").select("track_id", "i", "l", "r")


@query("SELECT l_returnflag AS track_id, count(*) AS frames, round(avg((l_quantity - 25) / 25), 9) AS mean, round(stddev_samp((l_quantity - 25) / 25), 9) AS std FROM lineitem GROUP BY 1")
def track_stats(spark, d):
    rows = src.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("track_id"), ((F.col("l_quantity") - 25) / 25).alias("l"))
    return audio.stats(rows, ["track_id"], "l").select("track_id", "frames", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"WITH {PCM}, c AS (SELECT track_id, count(*) AS n FROM pcm GROUP BY 1), w AS (SELECT track_id, n, k * (n - 50) // 19 AS a FROM c, (SELECT unnest(range(0, 20)) AS k)) SELECT track_id, count(*) AS frames, round(avg(l), 9) AS mean, round(stddev_samp(l), 9) AS std FROM pcm JOIN c USING (track_id) WHERE n <= 2000 OR EXISTS (SELECT 1 FROM w WHERE w.track_id = pcm.track_id AND i >= a AND i < a + 50) GROUP BY 1")
def stratified_stats(spark, d):
    pcm = _pcm(spark, d)
    counts = pcm.groupBy("track_id").agg(F.count("*").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(19)))
    spans = counts.withColumn("k", k).select("track_id", F.when(F.col("n") <= 2000, 0).otherwise(F.floor(F.col("k") * (F.col("n") - 50) / 19)).alias("s"), "n", "k").where("n > 2000 or k = 0")
    spans = spans.select("track_id", "s", F.when(F.col("n") <= 2000, F.col("n")).otherwise(F.col("s") + 49).alias("e"))
    picked = intervals.points_in(pcm, intervals.merge(spans, 0, ["track_id"]), ["track_id"], "i", "left_semi", 5000)
    return audio.stats(picked, ["track_id"], "l").select("track_id", "frames", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def _grid(jobs, frames, grid=audio.chunk_grid):
    return grid(jobs.select(F.col("id").alias("track_id"), frames.alias("frames"))).withColumn("chunk", F.col("chunk").cast("long"))


@query(f"WITH {JOBS}, t AS (SELECT id AS track_id, duration_ms AS f FROM jobs), c AS (SELECT track_id, f, unnest(range(0, CAST(ceil((f + 22050) / 103194e0) AS BIGINT))) AS chunk FROM t WHERE f > 0) SELECT track_id, chunk, chunk * 103194 - 22050 AS off, least(chunk * 103194 - 22050 + 114660, f) - greatest(chunk * 103194 - 22050, 0) AS n FROM c")
def chunk_grid(spark, d):
    """The grid of a sound of as many frames as the job has milliseconds; ``chunk_grid_all`` has the whole length."""
    return _grid(src.jobs(spark, d), F.col("duration_ms"))


@query()
def chunk_grid_all(spark, d):
    """Over two thousand rows a job, in an order that keeps its files small; no SQL is registered, a test compares with brute force."""
    return _grid(src.jobs(spark, d), F.floor(F.col("duration_ms") * 441 / 10), audio.chunk_grid_by_lots)


@query(f"WITH {PCM}, c AS (SELECT track_id, i, l, unnest([i // 36 - 1, i // 36]) AS ch FROM pcm), x AS (SELECT track_id, i AS pos, i - ch * 36 AS j, l * (1 + ch % 3) AS v FROM c WHERE ch >= 0 AND i - ch * 36 < 40) SELECT track_id, pos, round(sum(least(j + 1, 40 - j) / 20e0 * v) / sum(least(j + 1, 40 - j) / 20e0), 9) AS x FROM x GROUP BY 1, 2")
def overlap_add(spark, d):
    pcm = _pcm(spark, d).withColumn("ch", F.explode(F.array(F.floor(F.col("i") / 36) - 1, F.floor(F.col("i") / 36)))).where((F.col("ch") >= 0) & (F.col("i") - F.col("ch") * 36 < 40))
    chunks = pcm.groupBy("track_id", "ch").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("l") * (1 + F.col("ch") % 3)).alias("v")))).alias("rows"))
    chunks = chunks.select("track_id", (F.col("ch") * 36).alias("off"), F.transform("rows", lambda r: r["v"]).alias("x"))
    return audio.overlap_add(chunks, ["track_id"], 40).select("track_id", "pos", F.round("x", 9).alias("x"))


def _music(spark, d):
    ev = numbered(src.events(spark, d), ["video_id"], F.floor(F.col("pts_ms") / 10_000), ["pts_ms", "event_id"], "chunk")
    return ev.select("video_id", "chunk", (F.col("value") / 500).cast("float").alias("score"))


_DILATED = f"WITH {MUSIC}, dl AS (SELECT a.video_id, a.chunk, max(CASE WHEN abs(b.chunk - a.chunk) <= 1 THEN b.score END) >= 0.15::FLOAT OR (any_value(a.score) >= 0.02::FLOAT AND max(b.score) >= 0.15::FLOAT) AS separate FROM music a JOIN music b ON a.video_id = b.video_id AND b.chunk BETWEEN a.chunk - 2 AND a.chunk + 2 GROUP BY 1, 2)"


@query(f"{_DILATED} SELECT * FROM dl")
def music_dilation(spark, d):
    return audio.dilate(_music(spark, d), "video_id").select("video_id", "chunk", "separate")


@query(f"{_DILATED} SELECT video_id, count(*) AS done, count(*) FILTER (WHERE NOT separate) AS skipped, 100 * count(*) FILTER (WHERE NOT separate) // count(*) AS rate FROM dl GROUP BY 1")
def skip_rate(spark, d):
    x = audio.dilate(_music(spark, d), "video_id").groupBy("video_id").agg(F.count("*").alias("done"), F.count_if(~F.col("separate")).alias("skipped"))
    return x.withColumn("rate", F.floor(100 * F.col("skipped") / F.col("done")))


_MIX = "((l_quantity - 25) / 25 + 0.7071e0 * l_discount * 10 + 0.7071e0 * l_tax * 10)"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MIX} AS v FROM lineitem), y AS (SELECT *, CASE WHEN abs(v) <= 0.95e0 THEN v ELSE sign(v) * (0.95e0 + (1 - 2 / (exp(2 * ((abs(v) - 0.95e0) / 0.05e0)) + 1)) * 0.05e0) END AS c FROM x) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(-32768, least(32767, floor(round(c, 7) * 32767 + 0.5))) AS INT) AS q FROM y")
def downmix_softclip_quantize(spark, d):
    li = src.table(spark, d, "lineitem")
    six = [(F.col("l_quantity") - 25) / 25, F.lit(0.0), F.col("l_discount") * 10, F.lit(9.0), F.col("l_tax") * 10, F.lit(0.0)]
    left, _ = S.fold_down(six)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.quantized(F.round(S.soft_clip(left), 7)).alias("q"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey % 256)::INT AS y, (l_partkey % 256)::INT - 128 AS u, (l_suppkey % 256)::INT - 128 AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(255, y + ((1436 * v) >> 10))) AS r, greatest(0, least(255, y - ((352 * u + 731 * v) >> 10))) AS g, greatest(0, least(255, y + ((1815 * u) >> 10))) AS b FROM x")
def yuv_rgb(spark, d):
    byte = lambda c: (F.col(c) % 256).cast("int")
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.yuv_rgb(byte("l_orderkey"), byte("l_partkey"), byte("l_suppkey")).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*")


# ------------------------------------------------------------------ jobs


@query(f"WITH {JOBS} SELECT state, state IN ('DONE', 'FAILED') AS terminal, count(*) AS n FROM jobs GROUP BY ALL")
def job_states(spark, d):
    return src.jobs(spark, d).groupBy("state", F.col("state").isin(*S.TERMINAL).alias("terminal")).agg(F.count("*").alias("n"))


@query(f"WITH {JOBS} SELECT id, url, state FROM jobs WHERE state NOT IN ('DONE', 'FAILED')")
def job_pending(spark, d):
    return src.jobs(spark, d).where(~F.col("state").isin(*S.TERMINAL)).select("id", "url", "state")


@query(f"WITH {JOBS} SELECT min(id) AS id, url FROM jobs WHERE state NOT IN ('DONE', 'FAILED') GROUP BY url")
def job_dedupe(spark, d):
    live = src.jobs(spark, d).where(~F.col("state").isin(*S.TERMINAL))
    return live.groupBy("url").agg(F.min("id").alias("id")).select("id", "url")


@query(f"WITH {JOBS}, p AS (SELECT id, [url, remove_music::VARCHAR, coalesce(who, 'null'), '40', 'plan4'] AS x FROM ops) SELECT id, substr(sha256(list_aggregate(list_transform(x, lambda y: length(y) || ':' || y || '|'), 'string_agg', '')), 1, 16) AS key FROM p")
def job_key(spark, d):
    return src.jobs(spark, d).select("id", S.content_key(F.col("url"), F.col("remove_music"), S.who(F.col("who_raw")), F.lit(40), F.lit("plan4")).alias("key"))


_MSG = "(['No space left on device', 'crypto session lost', 'Decoder failed', 'connection timed out', 'Unable to extract', 'plain fault', NULL])[doc_id % 7 + 1]"


@query(f"WITH m AS (SELECT doc_id, lower({_MSG}) AS m, doc_id % 2 = 0 AS io FROM documents) SELECT doc_id, CASE WHEN m LIKE '%enospc%' OR m LIKE '%no space left%' THEN 'OUT_OF_SPACE' WHEN m LIKE '%crypto%' OR m LIKE '%drm%' THEN 'DRM' WHEN m LIKE '%codec%' OR m LIKE '%decoder%' OR m LIKE '%encoder%' OR m LIKE '%failed to initialize%' THEN 'UNSUPPORTED_CODEC' WHEN io THEN 'UNREADABLE' ELSE 'GENERIC' END AS filter_error, CASE WHEN m LIKE '%space%' OR m LIKE '%enospc%' THEN 'LOW_SPACE' WHEN m LIKE '%unsupported url%' OR m LIKE '%unable to extract%' OR m LIKE '%no video formats%' THEN 'UNSUPPORTED' WHEN m LIKE '%unable to download%' OR m LIKE '%timed out%' OR m LIKE '%connection%' OR m LIKE '%network%' THEN 'NETWORK' ELSE 'GENERIC' END AS download_error FROM m")
def error_classes(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("No space left on device", "crypto session lost", "Decoder failed", "connection timed out", "Unable to extract", "plain fault", None)]), (F.col("doc_id") % 7 + 1).cast("int"))
    return src.table(spark, d, "documents").select("doc_id", S.filter_error(said, F.col("doc_id") % 2 == 0).alias("filter_error"), S.download_error(said).alias("download_error"))


@query(f"WITH {REL} SELECT id, tag, dense_rank() OVER (ORDER BY n0, n1, is_release, letters, num) AS place FROM ver")
def version_order(spark, d):
    r = src.releases(spark, d).withColumn("v", S.version(F.col("tag")))
    distinct = r.select("v").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("v")).cast("long"))  # distinct tags only
    return r.join(distinct, "v").select("id", "tag", "place")


@query(f"WITH {REL}, i AS (SELECT unnest([1, 2, 3, 4]) AS n0, unnest([0, 5, 9, 2]) AS n1, unnest([true, false, true, false]) AS rel, unnest(['', 'beta', '', 'rc']) AS le, unnest([0, 2, 0, 1]) AS nu), c AS (SELECT i.n0 || '.' || i.n1 || CASE WHEN rel THEN '' ELSE '-' || le || nu END AS installed, tag, id, row_number() OVER (PARTITION BY i.n0, i.n1 ORDER BY ver.n0 DESC, ver.n1 DESC, is_release DESC, letters DESC, num DESC, id) AS k FROM i JOIN ver ON NOT draft AND (NOT prerelease OR NOT rel) AND (ver.n0, ver.n1, is_release, letters, num) > (i.n0, i.n1, rel, le, nu)) SELECT installed, tag, id FROM c WHERE k = 1")
def best_release(spark, d):
    r = src.releases(spark, d).where("not draft").withColumn("v", S.version(F.col("tag")))
    installed = spark.createDataFrame([("1.0",), ("2.5-beta2",), ("3.9",), ("4.2-rc1",)], "installed string").withColumn("iv", S.version(F.col("installed")))
    fit = r.join(F.broadcast(installed), (F.col("v") > F.col("iv")) & (~F.col("prerelease") | ~F.col("iv.is_release")))
    best = fit.groupBy("installed").agg(F.max_by(F.struct("tag", "id"), F.struct("v", (-F.col("id")).alias("o"))).alias("x"))
    return best.select("installed", "x.tag", "x.id")


@query(f"WITH {JOBS} SELECT id, url, added FROM jobs WHERE (url LIKE '%h1.%' OR url LIKE '%h2.%') AND state IN ('DONE', 'FILTERING') ORDER BY added DESC, id")
def library_listing(spark, d):
    return src.jobs(spark, d).where((F.col("url").like("%h1.%") | F.col("url").like("%h2.%")) & F.col("state").isin("DONE", "FILTERING")).select("id", "url", "added").orderBy(F.col("added").desc(), "id")


@query("SELECT page_id, nullif(regexp_extract('see ' || url || '. ok', 'https?://\\S*[^\\s.,]'), '') AS found FROM pages")
def url_scrape(spark, d):
    return src.table(spark, d, "pages").select("page_id", S.first_url(F.concat(F.lit("see "), F.col("url"), F.lit(". ok"))).alias("found"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages")
def url_host(spark, d):
    return src.table(spark, d, "pages").select("page_id", S.host(F.col("url")).alias("host"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN duration_ms <= 0 THEN 0 WHEN censor AND remove_music THEN duration_ms WHEN remove_music THEN floor(duration_ms * 0.68e0)::BIGINT WHEN censor THEN floor(duration_ms * 0.28e0)::BIGINT ELSE 0 END AS eta_ms, CASE WHEN id % 20 = 0 THEN 'audio-only' WHEN duration_ms >= 1800000 AND censor THEN 'segmented' WHEN censor AND remove_music THEN 'combined' WHEN remove_music THEN 'music' ELSE 'censor' END AS shape FROM ops")
def eta_shapes(spark, d):
    w = S.who(F.col("who_raw"))
    censor = F.coalesce(w != "none", F.lit(False))
    music, ms = F.col("remove_music"), F.col("duration_ms")
    return src.jobs(spark, d).select("id", S.eta_ms(ms, censor, music).alias("eta_ms"), S.shape(F.col("id") % 20 != 0, ms >= S.LONG_JOB_MS, censor, music).alias("shape"))


@query(f"WITH {JOBS}, x AS (SELECT *, CASE WHEN censor AND remove_music THEN 2 ELSE 1 END AS copies, duration_ms // 1000 * 176400 AS scratch FROM ops) SELECT id, (copies + 1) * source_bytes + scratch + 2147483648 AS required, (copies + 2) * source_bytes + 2147483648 AS for_download, CASE WHEN id % 13 = 0 THEN 'DRM' WHEN id % 17 = 0 THEN 'NO_VIDEO' WHEN remove_music AND id % 19 = 0 THEN 'NO_AUDIO' WHEN 4000000000 < (copies + 1) * source_bytes + scratch + 2147483648 THEN 'LOW_SPACE' END AS verdict FROM x")
def space_required(spark, d):
    i, censor, music = F.col("id"), F.coalesce(S.who(F.col("who_raw")) != "none", F.lit(False)), F.col("remove_music")
    scratch = F.floor(F.col("duration_ms") / 1000) * 176400
    need = S.required_bytes(F.col("source_bytes"), censor, music, scratch)
    return src.jobs(spark, d).select("id", need.alias("required"), S.required_bytes(F.col("source_bytes"), censor, music, F.lit(0), True).alias("for_download"), S.preflight(i % 13 == 0, i % 17 != 0, i % 19 != 0, music, F.lit(4_000_000_000), need).alias("verdict"))


@query("WITH x AS (SELECT p_partkey, p_size * 100000::BIGINT AS px, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE CAST(floor(p_retailprice * 20000) AS BIGINT) END AS br FROM part), y AS (SELECT *, CASE WHEN px <= 409920 THEN 4000000 WHEN px <= 921600 THEN 10000000 WHEN px <= 2073600 THEN 16000000 WHEN px <= 3686400 THEN 24000000 ELSE 45000000 END AS cap FROM x) SELECT p_partkey, CASE WHEN br > 0 THEN least(floor(br * 1.3e0)::BIGINT, cap) ELSE cap END AS bitrate FROM y")
def bitrate_tier(spark, d):
    source = F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(F.floor(F.col("p_retailprice") * 20000))
    return src.table(spark, d, "part").select("p_partkey", S.bitrate(F.col("p_size") * 100000, source).alias("bitrate"))


@query(f"WITH {EV} SELECT user_id, pts_ms // 86400 AS day, max(pts_ms) AS newest, sum(k)::BIGINT AS freed FROM ev GROUP BY 1, 2 HAVING max(pts_ms) < (SELECT max(pts_ms) FROM ev) - 604800")
def stale_dirs(spark, d):
    """Folders, one per user and day, whose newest file is a week older than the newest of all."""
    ev = src.events(spark, d)
    age = ev.groupBy("user_id", F.floor(F.col("pts_ms") / 86400).alias("day")).agg(F.max("pts_ms").alias("newest"), F.sum("k").alias("freed"))
    now = ev.agg(F.max("pts_ms").alias("_now"))  # one row
    return age.crossJoin(F.broadcast(now)).where(F.col("newest") < F.col("_now") - 604800).drop("_now")


@query(f"WITH {TRACK} SELECT video_id, track_key, start_ms AS s, end_ms AS e FROM span")
def edl_json_roundtrip(spark, d):
    """Spans written as JSON documents of [s, e] arrays and read back."""
    spans = tracks.spans(_tracked(spark, d))
    doc = spans.withColumn("j", F.to_json(F.struct(F.col("track_key").alias("id"), F.array("start_ms", "end_ms").alias("span"))))
    back = doc.withColumn("x", F.from_json("j", "id string, span array<bigint>"))
    return back.select("video_id", F.col("x.id").alias("track_key"), F.get("x.span", F.lit(0)).alias("s"), F.get("x.span", F.lit(1)).alias("e"))


@query(f"WITH {PCM}, c AS (SELECT track_id, count(*) AS n FROM pcm GROUP BY 1), p AS (SELECT track_id, i, 100 * i // n AS pct FROM pcm JOIN c USING (track_id)) SELECT track_id, i, pct FROM (SELECT *, lag(pct) OVER (PARTITION BY track_id ORDER BY i) AS before FROM p) WHERE pct IS DISTINCT FROM before")
def progress_changes(spark, d):
    pcm = _pcm(spark, d)
    pct = F.floor(100 * F.col("i") / F.col("n"))
    counts = F.broadcast(pcm.groupBy("track_id").agg(F.count("*").alias("n")))  # a row per track; a shuffle would put each track in one task
    rows = pcm.join(counts, "track_id").select("track_id", "i", pct.alias("pct"))
    return changes(rows, ["track_id"], F.floor(F.col("i") / 16_384), ["i"], "pct")


@query(f"WITH {EV}, g AS (SELECT video_id, event_id % 9 AS run, median(value) AS m FROM ev GROUP BY 1, 2) SELECT video_id, round(min(m), 6) AS best_median FROM g GROUP BY 1")
def latency_summary(spark, d):
    runs = src.events(spark, d).groupBy("video_id", (F.col("event_id") % 9).alias("run")).agg(F.median("value").alias("m"))
    return runs.groupBy("video_id").agg(F.round(F.min("m"), 6).alias("best_median"))


@query(f"WITH {JOBS} SELECT id, who, coalesce(who, CASE WHEN id % 2 = 0 THEN 'everyone' ELSE 'none' END) AS effective, CASE WHEN duration_ms // 60000 < 1 THEN '<1 min' WHEN duration_ms // 60000 < 60 THEN (duration_ms // 60000) || ' min' ELSE (duration_ms // 3600000) || ' h ' || (duration_ms // 60000 % 60) || ' min' END AS length FROM ops")
def options_wire(spark, d):
    w = S.who(F.col("who_raw"))
    return src.jobs(spark, d).select("id", w.alias("who"), F.coalesce(w, S.who_from_legacy(F.col("id") % 2 == 0)).alias("effective"), S.duration_text(F.col("duration_ms")).alias("length"))


# ------------------------------------------------------------------ dense kernels and streams (no SQL form: tested against numpy and the batch operators)


@query()
def stft_roundtrip(spark, d):
    """Per block of 65 536 samples of each track: relative error of the inverse of the transform, and a length check."""
    import numpy as np
    import pandas as pd

    from spanwise.functions import dense

    def apply(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("i").l.to_numpy()
        if len(x) < 2:  # nothing to reflect
            return pd.DataFrame({"track_id": [key[0]], "block": [key[1]], "n": [len(x)], "error": [0.0]})
        back = dense.istft(dense.stft(x, 64, 16), len(x), 64, 16)
        return pd.DataFrame({"track_id": [key[0]], "block": [key[1]], "n": [len(back)], "error": [float(np.round(np.abs(back - x).mean() / np.abs(x).mean(), 6))]})

    return _pcm(spark, d).withColumn("block", F.floor(F.col("i") / 65536)).groupBy("track_id", "block").applyInPandas(apply, "track_id string, block long, n long, error double")


@query()
def pixel_pack(spark, d):
    """A 16 x 12 picture per order, packed to 8 x 6: bytes out and their sum."""
    import numpy as np
    import pandas as pd

    from spanwise.functions import pictures

    def apply(batches):
        for rows in batches:
            k = rows.o_orderkey.to_numpy()[:, None]
            planes = [(np.arange(n) * step + k) % 256 for n, step in ((192, 7), (48, 5), (48, 3))]
            packed = pictures.packed(np.concatenate(planes, axis=1), 16, 12, 8, 6)
            yield pd.DataFrame({"o_orderkey": k[:, 0], "n_bytes": packed.shape[1], "total": packed.sum(axis=1)})

    return src.table(spark, d, "orders").select("o_orderkey").mapInPandas(apply, "o_orderkey long, n_bytes long, total long")


_STREAM = f"WITH {GATE}, x AS (SELECT video_id, pts_ms - 500 AS s, pts_ms + 1500 AS e FROM gate WHERE {_fired('100')}), {_merged('x', 1, 'm')} SELECT * FROM m"


@query(_STREAM)
def stream_hysteresis(spark, d):
    """Firings read back as a stream; session windows give the intervals of the batch form (unclamped)."""
    from spanwise.streaming import twins

    return _streamed(spark, gate.firings(src.gate_scores(spark, d), 100).select("video_id", F.timestamp_millis("pts_ms").alias("ts")), twins.hysteresis)


def _streamed(spark, rows, form, mode="complete"):
    """``rows`` written in the shared folder, read as a stream and run through ``form`` to its end."""
    import uuid

    from spanwise.session import shared_folder
    from spanwise.streaming import twins

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    return twins.settle(form(spark.readStream.schema(rows.schema).parquet(f"{base}/in")), base, mode)
