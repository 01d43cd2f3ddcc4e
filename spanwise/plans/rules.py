"""Registered queries of small rules: geometry, options, files, feeds, models, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwise.functions import scalar as S
from spanwise.operators import gate, intervals
from spanwise.operators.numbering import running
from spanwise.plans.catalogue import EV, FACE, GATE, JOBS, PCM, _fired, _merged, _pcm, query
from spanwise.sources import fixtures as src

# ------------------------------------------------------------------ geometry and pictures

_UP = "CASE WHEN event_id % 4 IN (1, 3) THEN 1080 ELSE 1920 END"
_UPH = "CASE WHEN event_id % 4 IN (1, 3) THEN 1920 ELSE 1080 END"


@query(
    f"WITH {FACE}, u AS (SELECT *, {_UP} AS uw, {_UPH} AS uh, floor(l * 1000)::BIGINT AS x0, floor(r * 1000)::BIGINT AS x1, floor(t * 1000)::BIGINT AS y0, floor(b * 1000)::BIGINT AS y1 FROM face) "
    "SELECT event_id, uw, uh, x1 - x0 AS w, y1 - y0 AS h, greatest(x1 - x0, y1 - y0) AS size, round(x0 / (uw * 1e0), 9) AS nl, round(y0 / (uh * 1e0), 9) AS nt, round(x1 / (uw * 1e0), 9) AS nr, round(y1 / (uh * 1e0), 9) AS nb, CASE WHEN uw >= uh THEN 'landscape' ELSE 'portrait' END AS orientation FROM u"
)
def picture_geometry(spark, d):
    """Pixel boxes of an upright picture: size, longer edge, share of the picture; the picture's own orientation."""
    w, h = S.upright_size(F.lit(1920), F.lit(1080), F.col("event_id") % 4 * 90)
    box = [F.floor(F.col(c) * 1000).alias(n) for c, n in (("l", "x0"), ("r", "x1"), ("t", "y0"), ("b", "y1"))]
    u = src.faces(spark, d).select("event_id", w.alias("uw"), h.alias("uh"), *box)
    part = S.normalized(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("uw"), F.col("uh"))
    bw, bh = S.box_size(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return u.select("event_id", "uw", "uh", bw.alias("w"), bh.alias("h"), F.greatest(bw, bh).alias("size"), *[F.round(c, 9).alias(n) for c, n in zip(part, ("nl", "nt", "nr", "nb"), strict=True)], S.orientation(F.col("uw"), F.col("uh")).alias("orientation"))


@query(
    "WITH p AS (SELECT p_partkey, 100 + p_size * 50 AS w, 90 + (p_partkey % 60) * 40 AS h FROM part), s AS (SELECT *, CASE WHEN greatest(w, h) > 1280 THEN 1280e0 / greatest(w, h) ELSE 1e0 END AS k FROM p) "
    "SELECT p_partkey, greatest(2, floor(w * k + 0.5e0)::INT) // 2 * 2 AS width, greatest(2, floor(h * k + 0.5e0)::INT) // 2 * 2 AS height FROM s"
)
def even_sizes(spark, d):
    """Downscaled to 1280 at most, rounded, even."""
    w, h = S.even_size(100 + F.col("p_size") * 50, 90 + (F.col("p_partkey") % 60) * 40, 1280)
    return src.table(spark, d, "part").select("p_partkey", w.cast("long").alias("width"), h.cast("long").alias("height"))


@query("SELECT o_orderkey, nullif(o_custkey, 0) IS NOT NULL AND o_custkey % 3 <> 0 AS solid, CASE WHEN o_custkey % 3 <> 0 THEN (o_orderkey * 2654435 + o_custkey) // 65536 % 256 END AS r, CASE WHEN o_custkey % 3 <> 0 THEN (o_orderkey * 2654435 + o_custkey) // 256 % 256 END AS g, CASE WHEN o_custkey % 3 <> 0 THEN (o_orderkey * 2654435 + o_custkey) % 256 END AS b FROM orders")
def colour_channels(spark, d):
    """Channels of an opaque colour; none where the colour stands for blur."""
    colour = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderkey") * 2654435 + F.col("o_custkey") + F.lit(1 << 45)).otherwise(F.lit(0).cast("long"))
    x = src.table(spark, d, "orders").select("o_orderkey", S.argb(colour).alias("c"))
    return x.select("o_orderkey", F.col("c").isNotNull().alias("solid"), *[F.col(f"c.{n}").cast("long").alias(n) for n in "rgb"])


@query("WITH c AS (SELECT o_orderkey, (o_orderkey % 200) / 100e0 AS d, 0.1e0 + (o_custkey % 5) / 20e0 AS f, o_custkey % 256 AS a, o_orderkey % 256 AS b FROM orders), m AS (SELECT *, greatest(0e0, least(1e0, (1 + f - d) / f)) AS t FROM c) SELECT o_orderkey, round(t * t * (3 - 2 * t), 9) AS mask, round(b + (a - b) * (t * t * (3 - 2 * t)), 6) AS mixed FROM m")
def feathered_mask(spark, d):
    """How far a pixel at distance d from a region's centre is covered, with a soft edge, and the mix of both colours."""
    c = src.table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 200) / 100.0).alias("d"), (0.1 + (F.col("o_custkey") % 5) / 20.0).alias("f"), (F.col("o_custkey") % 256).alias("a"), (F.col("o_orderkey") % 256).alias("b"))
    mask = S.feather(F.col("d"), F.col("f"))
    return c.select("o_orderkey", F.round(mask, 9).alias("mask"), F.round(F.col("b") + (F.col("a") - F.col("b")) * mask, 6).alias("mixed"))


# ------------------------------------------------------------------ sources


_KEYS = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'frame-rate=' || CASE WHEN o_orderkey % 4 = 1 THEN '29.97' WHEN o_orderkey % 4 = 2 THEN '25' ELSE 'fast' END || ';' END || CASE WHEN o_orderkey % 3 = 0 THEN 'crop-left=' || (o_custkey % 9) || ';crop-right=' || (o_custkey % 9 + 639) || ';' ELSE '' END || 'width=' || (o_custkey % 700 + 16) || ';display=' || CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE o_custkey::VARCHAR END"


@query(
    f"WITH k AS (SELECT o_orderkey AS id, {_KEYS} AS m FROM orders), v AS (SELECT id, TRY_CAST(nullif(regexp_extract(m, 'frame-rate=([^;]*)', 1), '') AS DOUBLE) AS fps, TRY_CAST(nullif(regexp_extract(m, 'crop-left=([^;]*)', 1), '') AS INT) AS cl, TRY_CAST(nullif(regexp_extract(m, 'crop-right=([^;]*)', 1), '') AS INT) AS cr, TRY_CAST(nullif(regexp_extract(m, '(?:^|;)width=([^;]*)', 1), '') AS INT) AS w, TRY_CAST(nullif(regexp_extract(m, 'display=([^;]*)', 1), '') AS BIGINT) AS size FROM k) "
    "SELECT id, coalesce(fps, 30e0) AS fps, coalesce(cr - cl + 1, w)::BIGINT AS width, coalesce(nullif(size, 0), CASE WHEN id % 2 = 0 THEN id * 10 END, 0) AS bytes FROM v"
)
def typed_keys(spark, d):
    """Optional typed keys of a format map: rate as float or int, inclusive crop else stored width, size from the first that knows."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    rate = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("frame-rate="), F.when(i % 4 == 1, "29.97").when(i % 4 == 2, "25").otherwise("fast"), F.lit(";")))
    crop = F.when(i % 3 == 0, F.concat(F.lit("crop-left="), c % 9, F.lit(";crop-right="), c % 9 + 639, F.lit(";"))).otherwise("")
    text = F.concat(rate, crop, F.lit("width="), c % 700 + 16, F.lit(";display="), F.when(c % 5 == 0, "x").otherwise(c.cast("string")))
    m = src.table(spark, d, "orders").select(i.alias("id"), F.str_to_map(text, F.lit(";"), F.lit("=")).alias("m"))
    width = F.coalesce(S.key("m", "crop-right", "int") - S.key("m", "crop-left", "int") + 1, S.key("m", "width", "int"))
    size = F.coalesce(F.nullif(S.key("m", "display", "long"), F.lit(0)), F.when(F.col("id") % 2 == 0, F.col("id") * 10), F.lit(0))
    return m.select("id", F.coalesce(S.key("m", "frame-rate", "double"), F.lit(30.0)).alias("fps"), width.cast("long").alias("width"), size.alias("bytes"))


@query("SELECT l_orderkey, min(l_linenumber) AS line, arg_min(l_partkey, l_linenumber) AS part FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) GROUP BY 1")
def required_track(spark, d):
    """The first track of each file; a file without one stops the job."""
    mime = F.lit("video/avc")
    t = src.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), mime.alias("mime"))
    found = t.groupBy("l_orderkey").agg(F.min(F.when(F.col("mime").startswith("video/"), F.col("at"))).alias("first"))
    return found.select("l_orderkey", S.required(F.col("first"), "no video track").alias("first")).select("l_orderkey", F.col("first.l_linenumber").alias("line"), F.col("first.l_partkey").alias("part"))


@query("SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN 'transcode' WHEN count(*) FILTER (WHERE l_partkey % 4 IN (1, 2)) = 0 THEN 'none' WHEN bool_or(l_partkey % 4 = 1) THEN 'copy' ELSE 'transcode' END AS plan, bool_or(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 4 = 0 END) IS NOT FALSE AS has_video FROM lineitem GROUP BY 1")
def sound_plan(spark, d):
    """Copy, transcode or none, transcode where the file cannot be read; a picture is there unless all tracks say no."""
    kind = F.col("l_partkey") % 4
    t = src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(kind.isin(1, 2)).alias("n"), F.bool_or(kind == 1).alias("fits"), F.bool_or(F.when(F.col("l_partkey") % 11 != 0, kind == 0)).alias("seen"))
    return t.select("l_orderkey", S.audio_plan(F.col("l_orderkey") % 7 != 0, F.col("n"), F.col("fits")).alias("plan"), F.coalesce("seen", F.lit(True)).alias("has_video"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'files/' || p_partkey END, CASE WHEN p_partkey % 5 = 0 THEN 'assets/' || p_partkey END) AS place, coalesce(CASE WHEN p_partkey % 7 = 0 THEN 'https://own/' || p_partkey END, CASE WHEN p_partkey % 2 = 0 THEN 'https://base/' || p_partkey END) AS link, sha256(p_name) AS digest FROM part")
def model_places(spark, d):
    """Installed file, else the bundled one; own link, else the base's; digest of the content."""
    p = F.col("p_partkey")
    at = lambda k, text: F.when(p % k == 0, F.concat(F.lit(text), p))
    return src.table(spark, d, "part").select("p_partkey", F.coalesce(at(3, "files/"), at(5, "assets/")).alias("place"), F.coalesce(at(7, "https://own/"), at(2, "https://base/")).alias("link"), F.sha2("p_name", 256).alias("digest"))


@query("WITH m AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey % 4 + 1 AS rank FROM nation), s AS (SELECT r_regionkey AS input, r_regionkey % 4 + 1 AS dims FROM region) SELECT k, name, input FROM m LEFT JOIN s ON dims = rank")
def model_shapes(spark, d):
    """Models beside the input shapes of their own rank."""
    m = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.sequence(F.lit(1), (F.col("n_regionkey") % 4 + 1).cast("int")).alias("shape"))
    s = src.table(spark, d, "region").select(F.col("r_regionkey").alias("input"), F.sequence(F.lit(1), (F.col("r_regionkey") % 4 + 1).cast("int")).alias("in_shape"))
    return m.join(s, F.size("shape") == F.size("in_shape"), "left").select("k", "name", "input")


@query("SELECT r_regionkey AS idx, r_name AS class, (r_regionkey + 1) / 10e0 AS threshold, v.c IS NOT NULL AS known FROM region LEFT JOIN (SELECT unnest(['ASIA', 'EUROPE', 'AFRICA']) AS c) v ON c = r_name")
def class_lookup(spark, d):
    """A class map read as CSV, checked for its count, order and an anchor; indexes found by name."""
    rows = src.table(spark, d, "region").select(F.concat_ws(",", "r_regionkey", "r_name", ((F.col("r_regionkey") + 1) / 10.0).cast("string")).alias("line"))
    x = rows.select(F.from_csv("line", F.lit("idx bigint, class string, threshold double")).alias("x")).select("x.*")
    facts = x.agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count_if((F.col("idx") == 2) & (F.col("class") == "ASIA")).alias("anchor"))
    good = facts.select(F.assert_true((F.col("n") == 5) & (F.col("lo") == 0) & (F.col("hi") == 4) & (F.col("anchor") == 1), F.lit("class map is not the one expected")).alias("ok"))
    wanted = spark.createDataFrame([("ASIA",), ("EUROPE",), ("AFRICA",)], "c string")
    joined = x.join(F.broadcast(wanted), F.col("class") == F.col("c"), "left")
    return joined.crossJoin(F.broadcast(good)).where("ok is null").select("idx", "class", "threshold", F.col("c").isNotNull().alias("known"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS state, 'file-' || lpad(l_partkey::VARCHAR, 7, '0') || '.' || ['mp4', 'part', 'ytdl', 'mkv', 'temp'][(l_partkey % 5 + 1)::INT] AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'Movies' ELSE 'Music' END AS folder, l_suppkey % 3 = 0 AS quarantined FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 5 IN (0, 3) AND l_quantity > 0")
def finished_files(spark, d):
    """Downloaded files that are whole and not empty, where they go by kind, and whether they lie in quarantine; owner's state by path."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp4", "part", "ytdl", "mkv", "temp")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("file-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("."), ext)
    path = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("/cache/quarantine/"), name)).otherwise(F.concat(F.lit("/data/"), name))
    mime = F.when(F.col("l_suppkey") % 2 == 0, "video/mp4").otherwise("audio/mp4")
    files = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), path.alias("path"), mime.alias("mime"), F.col("l_quantity").alias("bytes"))
    done = files.where(S.finished(F.col("name")) & (F.col("bytes") > 0))
    owners = src.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return done.join(owners, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "state", "name", S.folder(F.col("mime")).alias("folder"), F.col("path").startswith("/cache/quarantine/").alias("quarantined"))


_FEED = "f AS (SELECT p_partkey AS id, 'v' || (p_size // 10) || '.' || (p_size % 10) AS tag, p_partkey % 11 = 0 AS draft, p_partkey % 3 <> 0 AS pre, p_partkey % 5 AS n_assets, p_partkey % 4 AS own FROM part)"


@query(f"WITH {_FEED} SELECT id, tag, CASE WHEN n_assets > own THEN 'https://x/' || id || '/app-arm64-' || own || '.apk' ELSE 'https://x/' || id || '/app-all-0.apk' END AS asset FROM f WHERE NOT draft AND NOT pre AND p_is_new(tag) AND n_assets > 0".replace("p_is_new(tag)", "(split_part(substr(tag, 2), '.', 1)::INT, split_part(substr(tag, 2), '.', 2)::INT) > (2, 3) AND tag <> 'v3.7'"))
def release_feed(spark, d):
    """Release documents as a JSON array each: those newer than the installed one and not skipped, with their preferred asset."""
    p = F.col("p_partkey")
    tag = F.concat(F.lit("v"), F.expr("p_size div 10"), F.lit("."), F.col("p_size") % 10)
    asset = lambda k: F.struct(F.concat(F.lit("app-"), F.when(k == p % 4, "arm64").otherwise("all"), F.lit("-"), k, F.lit(".apk")).alias("name"), F.concat(F.lit("https://x/"), p, F.lit("/app-"), F.when(k == p % 4, "arm64").otherwise("all"), F.lit("-"), k, F.lit(".apk")).alias("url"))
    assets = F.when(p % 5 > 0, F.transform(F.sequence(F.lit(0).cast("long"), p % 5 - 1), asset)).otherwise(F.array().cast("array<struct<name:string,url:string>>"))
    doc = F.to_json(F.array(F.struct(p.alias("id"), tag.alias("tag_name"), (p % 11 == 0).alias("draft"), (p % 3 != 0).alias("prerelease"), assets.alias("assets"))))
    feed = src.table(spark, d, "part").select(F.explode(F.from_json(doc, "array<struct<id:bigint,tag_name:string,draft:boolean,prerelease:boolean,assets:array<struct<name:string,url:string>>>>")).alias("x")).select("x.*")
    best = S.preferred_asset(F.col("assets"), "arm64")
    fresh = feed.where(~F.col("draft") & ~F.col("prerelease") & (S.version(F.col("tag_name")) > S.version(F.lit("v2.3"))) & ~F.col("tag_name").eqNullSafe(F.lit("v3.7")))
    return fresh.select("id", F.col("tag_name").alias("tag"), best.alias("asset")).where("asset is not null")


@query(f"WITH {_FEED} SELECT id, tag, rank FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS rank FROM f WHERE NOT draft) WHERE rank <= 10")
def release_page(spark, d):
    """The newest ten releases: one page of the feed."""
    tag = F.concat(F.lit("v"), F.expr("p_size div 10"), F.lit("."), F.col("p_size") % 10)
    page = src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), tag.alias("tag")).where("id % 11 <> 0").orderBy(F.desc("id")).limit(10)
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("id"))).cast("long"))  # ten rows


# ------------------------------------------------------------------ options, estimates, errors


@query(
    f"WITH {JOBS} SELECT id, CASE WHEN (id % 4 = 0 OR id % 101 = 0) AND id % 3 <> 0 AND id % 5 <> 0 THEN 25 WHEN id % 4 = 0 THEN 0 ELSE id % 101 END AS blur, duration_ms // 1000 * 176400 + CASE WHEN id % 2 = 0 THEN duration_ms // 1000 * 24000 ELSE 0 END AS scratch, CASE WHEN id % 3 = 0 THEN 'P1080' WHEN id % 3 = 1 THEN 'P720' ELSE 'BEST' END AS quality, CASE WHEN id % 8 = 0 THEN false ELSE censor END AS censor, id % 10 * 86400000 > 604800000 AS weekly, id % 40 * 3600000 > 86400000 AS daily, id % 50 * 1000 // 1000 + id % 7 AS start_ms, abs(id % 90000 - 45000) > 44100 AS length_off FROM ops"
)
def option_rules(spark, d):
    """Blur that would do nothing, scratch space, quality by name, sound-only jobs, due checks, clipped starts, length warnings."""
    i, ms = F.col("id"), F.col("duration_ms")
    name = F.when(i % 3 == 0, "P1080").when(i % 3 == 1, "P720").otherwise("huge")
    censor = F.coalesce(S.who(F.col("who_raw")) != "none", F.lit(False))
    return src.jobs(spark, d).select(
        "id", S.blur_amount(F.when(i % 4 == 0, 0).otherwise(i % 101), i % 3 == 0, i % 5 == 0).alias("blur"), S.scratch_bytes(ms, i % 2 == 0).alias("scratch"), S.quality(name).alias("quality"),
        S.censors(censor, i % 8 == 0).alias("censor"), S.due(i % 10 * 86_400_000, F.lit(0), 7 * 86_400_000).alias("weekly"), S.due(i % 40 * 3_600_000, F.lit(0), 86_400_000).alias("daily"),
        S.offset_ms(i % 50 * 1000, i % 7).alias("start_ms"), S.length_off(i % 90_000, F.lit(45_000)).alias("length_off"),
    )


@query("WITH x AS (SELECT o_orderkey AS id, o_orderkey % 130 - 10 AS sub, o_custkey % 101 AS a, o_custkey % 73 AS b FROM orders) SELECT id, least(100, greatest(0, 20 + greatest(0, least(100, sub)) * 55 // 100)) AS band, a * 40 // 100 + b * 60 // 100 AS both, 'h' || a || CASE WHEN id % 3 = 0 THEN '' ELSE ' · ' || b END AS label FROM x")
def progress_bands(spark, d):
    """A step's percent inside its band, two steps' shares summed, and a label of the parts that are there."""
    x = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 130 - 10).alias("sub"), (F.col("o_custkey") % 101).alias("a"), (F.col("o_custkey") % 73).alias("b"))
    label = F.concat_ws(" · ", F.concat(F.lit("h"), "a"), F.when(F.col("id") % 3 != 0, F.col("b").cast("string")))
    return x.select("id", S.band(F.lit(20), F.lit(55), F.col("sub")).alias("band"), S.shares((F.col("a"), 40), (F.col("b"), 60)).alias("both"), label.alias("label"))


_SAID = "['write: ENOSPC in codec', 'No space left, network down', 'DRM: decoder failed to initialize', 'Failed to initialize encoder', 'unsupported url: connection', 'timed out, unable to extract', 'HTTP 404', 'Unable to download: network', '', 'checksum mismatch of model', 'sha256 differs; timed out', NULL]"


def _classes(m, branches):
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({m}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in branches) + " ELSE 'GENERIC' END"


_DOWN = (("LOW_SPACE", ("enospc", "no space left", "space")), ("UNSUPPORTED", ("unsupported url", "unable to extract", "no video formats")), ("NETWORK", ("unable to download", "timed out", "connection", "network")))
_FILTER = (("OUT_OF_SPACE", ("enospc", "no space left")), ("DRM", ("crypto", "drm")), ("UNSUPPORTED_CODEC", ("codec", "decoder", "encoder", "failed to initialize")))
_MODEL = (("CORRUPT", ("checksum", "sha256")), ("LOW_SPACE", ("enospc", "no space left")), ("NETWORK", ("timed out", "connection", "network", "http")))


@query(f"WITH x AS (SELECT o_orderkey AS id, lower({_SAID}[(o_orderkey % 12 + 1)::INT]) AS m FROM orders) SELECT id, {_classes('m', _FILTER)} AS filtering, {_classes('m', _DOWN)} AS downloading, {_classes('m', _MODEL)} AS modelling FROM x")
def error_orders(spark, d):
    """Messages that hold several keywords: the first class of each order counts."""
    said = F.array(*[F.lit(m) for m in ("write: ENOSPC in codec", "No space left, network down", "DRM: decoder failed to initialize", "Failed to initialize encoder", "unsupported url: connection", "timed out, unable to extract", "HTTP 404", "Unable to download: network", "", "checksum mismatch of model", "sha256 differs; timed out", None)])
    x = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(said, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("m"))
    return x.select("id", S.filter_error(F.col("m"), F.lit(False)).alias("filtering"), S.download_error(F.col("m")).alias("downloading"), S.model_error(F.col("m")).alias("modelling"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000 END, CASE WHEN p_partkey % 3 = 0 THEN p_size * 900 END, 0) AS bitrate, printf('an-%03d.json', p_size) AS analysis, printf('seg-%03d.mp4', p_size) AS segment, 'item:' || p_partkey AS tag FROM part WHERE p_partkey % 9 <> 0")
def key_names(spark, d):
    """Names of checkpoint files and tags; bitrate of the track, else of the file; only runs with a queue id."""
    p, n = F.col("p_partkey"), F.col("p_size").cast("int")
    x = src.table(spark, d, "part").withColumn("item", F.when(p % 9 != 0, p)).where("item is not null")
    return x.select("p_partkey", F.coalesce(F.when(p % 2 == 0, n * 1000), F.when(p % 3 == 0, n * 900), F.lit(0)).alias("bitrate"), F.format_string("an-%03d.json", n).alias("analysis"), F.format_string("seg-%03d.mp4", n).alias("segment"), F.concat(F.lit("item:"), "item").alias("tag"))


# ------------------------------------------------------------------ frames, sound and reports


@query(f"WITH {EV} SELECT video_id, count(*) AS n, min(pts_ms) AS first_ms, max(pts_ms) AS last_ms FROM ev WHERE pts_ms >= 600000 AND pts_ms < 1200000 GROUP BY 1")
def window_clip(spark, d):
    """Frames of [start, end) only."""
    clip = S.inside(F.col("pts_ms"), 600_000, 1_200_000)
    return src.events(spark, d).where(clip).groupBy("video_id").agg(F.count("*").alias("n"), F.min("pts_ms").alias("first_ms"), F.max("pts_ms").alias("last_ms"))


@query(f"WITH {GATE}, f AS (SELECT video_id, pts_ms // 300000 AS seg, greatest(0, pts_ms - 500) AS s, least(d, pts_ms + 1500) AS e FROM gate JOIN dur USING (video_id) WHERE {_fired('40')}), {_merged('f', 1, 'm')} SELECT * FROM m")
def folded_segments(spark, d):
    """Firings of each analysed segment, folded into one timeline before the single hysteresis pass."""
    fired = gate.firings(src.gate_scores(spark, d)).withColumn("seg", F.floor(F.col("pts_ms") / 300_000))
    even, odd = fired.where("seg % 2 = 0"), fired.where("seg % 2 <> 0")  # segments arrive as tables of their own
    ends = src.events(spark, d).groupBy("video_id").agg(F.max("pts_ms").alias("duration_ms"))
    return gate.hysteresis(even.unionByName(odd).drop("seg"), ends)


@query(f"WITH {FACE}, o AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY px DESC, event_id) AS n FROM face) SELECT video_id, event_id, printf('crop-%03d-%d.png', n, event_id) AS name FROM o WHERE n <= 240")
def crop_dump(spark, d):
    """The 240 largest crops of every video, named by rank."""
    # a bucket's first 240 hold every one that the video's first 240 hold
    part = Window.partitionBy("video_id", "_b").orderBy(F.desc("px"), "event_id")
    local = src.faces(spark, d).withColumn("_b", F.pmod(F.xxhash64("event_id"), F.lit(64))).withColumn("n", F.row_number().over(part)).where("n <= 240")
    ranked = local.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("px"), "event_id"))).where("n <= 240")
    return ranked.select("video_id", "event_id", F.format_string("crop-%03d-%d.png", "n", "event_id").alias("name"))


@query("WITH x AS (SELECT vec_id, greatest(list_max(embedding[1:20]), list_max(embedding[41:64])) AS m FROM embeddings) SELECT vec_id // 10 AS frame, round(max(m)::DOUBLE, 6) AS music, max(m) >= 0.15::FLOAT AS is_music FROM x GROUP BY 1")
def music_score(spark, d):
    """Best score over two class ranges and over the frames of a chunk."""
    best = F.greatest(F.array_max(F.slice("embedding", 1, 20)), F.array_max(F.slice("embedding", 41, 24)))
    x = src.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("frame"), best.alias("m"))
    return x.groupBy("frame").agg(F.round(F.max("m").cast("double"), 6).alias("music"), (F.max("m") >= F.lit(0.15).cast("float")).alias("is_music"))


@query(f"WITH {PCM}, a AS (SELECT track_id, i, l, r, l / 2 AS c, r / 4 AS ls, l * r AS rs FROM pcm) SELECT track_id, i, round(CASE i % 3 WHEN 0 THEN l WHEN 1 THEN l ELSE l + 0.7071e0 * c + 0.7071e0 * ls END, 9) AS left, round(CASE i % 3 WHEN 0 THEN l WHEN 1 THEN r ELSE r + 0.7071e0 * c + 0.7071e0 * rs END, 9) AS right FROM a")
def channel_folds(spark, d):
    """Mono doubled, stereo kept, six channels folded; both sides."""
    c = F.when(F.col("i") % 3 == 0, F.array("l")).when(F.col("i") % 3 == 1, F.array("l", "r")).otherwise(F.array("l", "r", F.col("l") / 2, F.lit(9.0), F.col("r") / 4, F.col("l") * F.col("r")))
    x = _pcm(spark, d).select("track_id", "i", S.stereo(c).alias("s"))
    return x.select("track_id", "i", F.round(F.get("s", F.lit(0)), 9).alias("left"), F.round(F.get("s", F.lit(1)), 9).alias("right"))


@query(f"WITH {PCM}, f AS (SELECT track_id, i, CASE WHEN i % 97 = 0 THEN 'NaN'::DOUBLE WHEN i % 89 = 0 THEN 'Infinity'::DOUBLE ELSE l END AS x FROM pcm) SELECT track_id, count(*) AS frames, count(*) FILTER (WHERE isnan(x) OR isinf(x)) AS bad, round(sum(CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END), 6) AS total FROM f GROUP BY 1")
def finite_samples(spark, d):
    """Samples that are no numbers count as 0, and are counted; a track without samples stops the job."""
    x = _pcm(spark, d).select("track_id", F.when(F.col("i") % 97 == 0, float("nan")).when(F.col("i") % 89 == 0, float("inf")).otherwise(F.col("l")).alias("x"))
    t = x.groupBy("track_id").agg(F.count("*").alias("frames"), F.count_if(~S.finite(F.col("x"))).alias("bad"), F.round(F.sum(S.finite_or_zero(F.col("x"))), 6).alias("total"))
    return t.withColumn("frames", S.required(F.when(F.col("frames") > 0, F.col("frames")), "no samples"))


@query(f"WITH {PCM}, b AS (SELECT track_id, i // 1000 AS buffer, count(*) AS n FROM pcm GROUP BY 1, 2) SELECT track_id, buffer, n, 41000 + coalesce(sum(n) OVER (PARTITION BY track_id ORDER BY buffer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 1000000 // 44100 AS pts_us FROM b")
def sample_clock(spark, d):
    """Presentation time of each buffer by the running count of samples before it."""
    buffers = _pcm(spark, d).groupBy("track_id", F.floor(F.col("i") / 1000).alias("buffer")).agg(F.count("*").alias("n"))
    counted = running(buffers, ["track_id"], F.floor(F.col("buffer") / 256), ["buffer"], F.col("n"), "before")
    return counted.select("track_id", "buffer", "n", S.sample_pts_us(F.lit(41_000), F.col("before")).alias("pts_us"))


@query(f"WITH {PCM}, c AS (SELECT track_id, count(*) AS n FROM pcm GROUP BY 1), f AS (SELECT track_id, n, unnest(range(0, CAST(ceil(n / 15600e0) AS BIGINT))) AS k FROM c) SELECT track_id, k, greatest(0, least(k * 15600, n - 15600)) AS s, least(n, greatest(0, least(k * 15600, n - 15600)) + 15600) AS e FROM f")
def tail_frames(spark, d):
    """Tumbling frames of 15 600 samples, the last one moved back so that it ends with the track."""
    n = _pcm(spark, d).groupBy("track_id").agg(F.count("*").alias("n"))
    k = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 15_600) - 1)))
    start = F.greatest(F.lit(0).cast("long"), F.least(F.col("k") * 15_600, F.col("n") - 15_600))
    return k.select("track_id", "k", start.alias("s"), F.least(F.col("n"), start + 15_600).alias("e"))


@query(f"WITH {PCM}, m AS (SELECT track_id, i, 0.5e0 * (l + r) AS x, lead(0.5e0 * (l + r)) OVER (PARTITION BY track_id ORDER BY i) AS nx, count(*) OVER (PARTITION BY track_id) AS n FROM pcm), o AS (SELECT track_id, j, j * 441 // 160 AS i, (j * 441 % 160) / 160e0 AS f FROM (SELECT track_id, unnest(range(0, n * 160 // 441)) AS j FROM (SELECT DISTINCT track_id, n FROM m))) SELECT o.track_id, j, round(x + (coalesce(nx, x) - x) * f, 9) AS x FROM o JOIN m ON m.track_id = o.track_id AND m.i = o.i")
def resampled(spark, d):
    """Both sides folded to one and resampled 441:160 by linear interpolation, each output sample from its two neighbours."""
    mono = _pcm(spark, d).select("track_id", "i", S.mono(F.col("l"), F.col("r")).alias("x"))
    n = mono.groupBy(F.col("track_id").alias("_t")).agg(F.count("*").alias("n"))  # a row per track
    # output j reads inputs floor(441 j / 160) and the next: every input says which outputs it serves
    j0, j1 = lambda i: F.ceil(i * 160 / 441), lambda i: F.ceil((i + 1) * 160 / 441) - 1
    a = mono.withColumn("j", F.explode(F.when(j1(F.col("i")) >= j0(F.col("i")), F.sequence(j0(F.col("i")), j1(F.col("i")))).otherwise(F.array().cast("array<bigint>")))).select("track_id", "j", F.col("x").alias("a"))
    b = mono.where("i > 0").withColumn("j", F.explode(F.when(j1(F.col("i") - 1) >= j0(F.col("i") - 1), F.sequence(j0(F.col("i") - 1), j1(F.col("i") - 1))).otherwise(F.array().cast("array<bigint>")))).select("track_id", "j", F.col("x").alias("b"))
    f = (F.col("j") * 441 % 160) / 160.0
    both = a.join(b, ["track_id", "j"], "left").join(n, F.col("track_id") == F.col("_t")).where(F.col("j") < F.floor(F.col("n") * 160 / 441))
    return both.select("track_id", "j", F.round(F.col("a") + (F.coalesce("b", "a") - F.col("a")) * f, 9).alias("x"))


@query("SELECT o_orderkey, o_custkey % 400000 AS n, CAST(ceil((o_custkey % 400000) / 1024e0) AS BIGINT) AS le, 1536 + CAST(ceil((o_custkey % 400000) / 1024e0) AS BIGINT) * 1024 - o_custkey % 400000 AS pad_right, CAST(ceil((o_custkey % 400000) / 1024e0) AS BIGINT) + 4 AS frames FROM orders")
def transform_frames(spark, d):
    """How many frames of a transform a length gives, and the padding on its right."""
    n = F.col("o_custkey") % 400_000
    le, right, frames = S.transform_grid(n)
    return src.table(spark, d, "orders").select("o_orderkey", n.alias("n"), le.alias("le"), right.alias("pad_right"), frames.alias("frames"))


@query(
    f"WITH {GATE}, o AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN porn ELSE sexy END AS sexy2, CASE WHEN event_id % 10 = 0 THEN sexy ELSE porn END AS porn2 FROM gate) SELECT video_id, count(*) AS n, count(*) FILTER (WHERE (CASE greatest(drawings, hentai, neutral, porn, sexy) WHEN drawings THEN 0 WHEN hentai THEN 1 WHEN neutral THEN 2 WHEN porn THEN 3 ELSE 4 END) = (CASE greatest(drawings, hentai, neutral, porn2, sexy2) WHEN drawings THEN 0 WHEN hentai THEN 1 WHEN neutral THEN 2 WHEN porn2 THEN 3 ELSE 4 END)) AS agree, round(max(greatest(abs(porn::DOUBLE - porn2::DOUBLE), abs(sexy::DOUBLE - sexy2::DOUBLE))), 6) AS largest, round(avg((abs(porn::DOUBLE - porn2::DOUBLE) + abs(sexy::DOUBLE - sexy2::DOUBLE)) / 5), 6) AS mean FROM o GROUP BY 1"
)
def model_agreement(spark, d):
    """Two runs of a model: equal top class, largest and mean difference."""
    g = src.gate_scores(spark, d)
    swap = F.col("event_id") % 10 == 0
    o = g.withColumn("porn2", F.when(swap, F.col("sexy")).otherwise(F.col("porn"))).withColumn("sexy2", F.when(swap, F.col("porn")).otherwise(F.col("sexy")))
    first = lambda *names: F.array_position(F.array(*names), F.greatest(*names))
    dp, ds = F.abs(F.col("porn").cast("double") - F.col("porn2").cast("double")), F.abs(F.col("sexy").cast("double") - F.col("sexy2").cast("double"))
    same = first("drawings", "hentai", "neutral", "porn", "sexy") == first("drawings", "hentai", "neutral", "porn2", "sexy2")
    return o.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.round(F.max(F.greatest(dp, ds)), 6).alias("largest"), F.round(F.avg((dp + ds) / 5), 6).alias("mean"))


@query(f"WITH {FACE} SELECT video_id, round(avg(px / 10e0), 6) AS cost_ms, count(*) FILTER (WHERE vote = 0) AS abstained, count(*) FILTER (WHERE event_id % 13 = 0) AS failed, max(event_id % 5) AS hottest, max(px * 1000) AS peak FROM face GROUP BY 1")
def run_report(spark, d):
    """Vote cost per crop, abstentions, failures, the highest thermal level and the peak memory."""
    i = F.col("event_id")
    return src.faces(spark, d).groupBy("video_id").agg(F.round(F.avg(F.col("px") / 10.0), 6).alias("cost_ms"), F.count_if(F.col("vote") == 0).alias("abstained"), F.count_if(i % 13 == 0).alias("failed"), F.max(i % 5).alias("hottest"), F.max(F.col("px") * 1000).alias("peak"))


_FIVE = ("l_returnflag", "l_linestatus", "l_shipmode", "l_shipinstruct", "l_tax")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> f1 OR l_linestatus <> f2 OR l_suppkey % 2 <> f3 OR l_partkey % 3 <> f4 OR l_tax <> f5) AS misfits FROM (SELECT *, first_value(l_returnflag) OVER w AS f1, first_value(l_linestatus) OVER w AS f2, first_value(l_suppkey % 2) OVER w AS f3, first_value(l_partkey % 3) OVER w AS f4, first_value(l_tax) OVER w AS f5 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) GROUP BY 1")
def part_configurations(spark, d):
    """Parts that differ from the first part in any of five keys of their configuration."""
    five = F.struct("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 2).alias("a"), (F.col("l_partkey") % 3).alias("b"), "l_tax")
    t = src.table(spark, d, "lineitem").select("l_orderkey", five.alias("five"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    # counts per configuration, then those beside the first part's own: no window over the parts
    kinds = t.groupBy("l_orderkey", "five").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    whole = kinds.groupBy("l_orderkey").agg(F.sum("n").alias("all"), F.min_by("n", "at").alias("like"))
    return whole.select("l_orderkey", (F.col("all") - F.col("like")).alias("misfits"))
