"""Scalar rules as Column functions; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1 << 30
#: Fixed values of the estimates and limits.
ETA_FACTORS = {"both": 1.0, "music": 0.68, "censor": 0.28}
BITRATE_CAPS = ((854 * 480, 4_000_000), (1280 * 720, 10_000_000), (1920 * 1080, 16_000_000), (2560 * 1440, 24_000_000))
TOP_BITRATE, HEADROOM = 45_000_000, 1.3
LONG_JOB_MS, TERMINAL = 30 * 60_000, ("DONE", "FAILED")
MUXABLE = ("audio/mp4a-latm", "audio/3gpp", "audio/amr-wb")


def who(raw: Column) -> Column:
    """Trimmed, lower-cased; blank is null, anything unknown means everyone."""
    w = F.lower(F.trim(raw))
    return F.when(w == "", None).when(w.isin("none", "everyone", "women", "men"), w).when(w.isNotNull(), F.lit("everyone"))


def who_from_legacy(flag: Column) -> Column:
    return F.when(flag, "everyone").otherwise("none")


def eta_ms(duration_ms: Column, censor: Column, music: Column) -> Column:
    """Least wall clock; 0 where nothing is known. Truncates."""
    factor = F.when(censor & music, ETA_FACTORS["both"]).when(music, ETA_FACTORS["music"]).when(censor, ETA_FACTORS["censor"]).otherwise(0.0)
    return F.when(duration_ms > 0, (duration_ms * factor).cast("long")).otherwise(F.lit(0).cast("long"))


def live_eta_ms(elapsed_ms: Column, percent: Column) -> Column:
    return F.when(percent >= 3, F.floor(elapsed_ms * (100 - percent) / percent)).otherwise(F.lit(0)).cast("long")


def required_bytes(source: Column, censor: Column, music: Column, scratch: Column, download: bool = False) -> Column:
    copies = F.when(censor & music, 2).otherwise(1) + int(download)
    return (copies + 1) * source + scratch + F.lit(2 * GIB)


def bitrate(pixels: Column, source: Column) -> Column:
    """Source bitrate with headroom, under a cap by pixel tier; an unknown source gets the cap."""
    cap = F.lit(TOP_BITRATE)
    for most, rate in reversed(BITRATE_CAPS):
        cap = F.when(pixels <= most, rate).otherwise(cap)
    return F.when(source > 0, F.least((source * HEADROOM).cast("long"), cap.cast("long"))).otherwise(cap.cast("long"))


def filter_error(message: Column, unreadable: Column) -> Column:
    """First class that applies; the order is part of the rule."""
    m = F.lower(message)
    has = lambda *words: F.coalesce(sum((m.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return (
        F.when(has("enospc", "no space left"), "OUT_OF_SPACE").when(has("crypto", "drm"), "DRM")
        .when(has("codec", "decoder", "encoder", "failed to initialize"), "UNSUPPORTED_CODEC").when(unreadable, "UNREADABLE").otherwise("GENERIC")
    )


def download_error(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: F.coalesce(sum((m.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return (
        F.when(has("enospc", "no space left", "space"), "LOW_SPACE").when(has("unsupported url", "unable to extract", "no video formats"), "UNSUPPORTED")
        .when(has("unable to download", "timed out", "connection", "network"), "NETWORK").otherwise("GENERIC")
    )


def preflight(drm: Column, has_video: Column, has_audio: Column, needs_audio: Column, free: Column, required: Column) -> Column:
    """The first failing check, or null."""
    return F.when(drm, "DRM").when(~has_video, "NO_VIDEO").when(needs_audio & ~has_audio, "NO_AUDIO").when(free < required, "LOW_SPACE")


def content_key(*parts: Column) -> Column:
    """First 8 bytes of SHA-256 over length-delimited parts, in hex; null counts as the text "null". Lengths are in UTF-16 units."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    units = lambda t: F.length(t) + F.regexp_count(t, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return F.substring(F.sha2(F.concat(*[F.concat(units(t).cast("string"), F.lit(":"), t, F.lit("|")) for t in texts]), 256), 1, 16)


def version(tag: Column) -> Column:
    """A struct that sorts like versions do; null if the tag does not start with a number.

    Up to four numbers, a missing one is 0; a release is above its pre-releases; these go by
    letters, then by number.
    """
    s = F.regexp_replace(F.trim(tag), "^[vV]", "")
    nums, pre = F.split(F.split_part(s, F.lit("-"), F.lit(1)), "\\."), F.regexp_extract(s, "^[^-]*-(.*)$", 1)
    n = [F.coalesce(F.try_element_at(nums, F.lit(i)).try_cast("int"), F.lit(0)).alias(f"n{i - 1}") for i in range(1, 5)]
    letters = F.regexp_extract(pre, "^([^0-9]*)", 1)
    number = F.coalesce(F.regexp_extract(pre, "^[^0-9]*(.*)$", 1).try_cast("int"), F.lit(0))
    return F.when(s.rlike("^[0-9]"), F.struct(*n, (pre == "").alias("is_release"), letters.alias("letters"), number.alias("num")))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"https?://\S*[^\s.,]", 0), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.parse_url(url, F.lit("HOST")), "^www\\.", "")


def duration_text(ms: Column) -> Column:
    minutes = F.floor(ms / 60000)
    return F.when(minutes < 1, "<1 min").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))


def size_text(size: Column) -> Column:
    return F.when(size >= 10**9, F.concat(F.round(size / 1e9, 1).cast("decimal(20,1)").cast("string"), F.lit(" GB"))).otherwise(F.concat(F.floor(size / 1e6).cast("string"), F.lit(" MB")))


def rotated(left: Column, top: Column, right: Column, bottom: Column, degrees: Column) -> Column:
    """Upright rectangle -> stored space; degrees modulo 360, others than quarter turns pass through."""
    d, one = F.pmod(degrees, F.lit(360)), F.lit(1.0)
    pack = lambda a, b, c, e: F.struct(a.alias("l"), b.alias("t"), c.alias("r"), e.alias("b"))
    return F.when(d == 90, pack(top, one - right, bottom, one - left)).when(d == 180, pack(one - right, one - bottom, one - left, one - top)).when(d == 270, pack(one - bottom, left, one - top, right)).otherwise(pack(left, top, right, bottom))


def padded(low: Column, high: Column, share: float = 0.25) -> tuple[Column, Column]:
    """An edge pair widened by a share of its length on each side, inside [0, 1]."""
    pad = (high - low) * share
    return F.greatest(F.lit(0.0), low - pad), F.least(F.lit(1.0), high + pad)


def even_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Downscaled (never up) to at most ``most``, rounded, forced even, at least 2."""
    longest = F.greatest(width, height)
    scale = F.when(longest > most, F.lit(float(most)) / longest).otherwise(1.0)
    force = lambda x: F.call_function("shiftleft", F.call_function("shiftright", F.greatest(F.lit(2), F.floor(x * scale + 0.5).cast("int")), F.lit(1)), F.lit(1))
    return force(width), force(height)


def blur_plan(amount: Column, width: Column, height: Column) -> Column:
    """``sigma, down, radius`` of a blur of 0..100 for a picture size."""
    sigma = F.greatest(F.lit(0.1), amount / 100.0 * 40.0 * (F.least(width, height) / 1080.0))
    down = F.when(sigma <= 4, 1).when(sigma <= 8, 2).when(sigma <= 16, 4).otherwise(8)
    radius = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.round(2.5 * sigma / down, 9)).cast("int")))
    return F.struct(F.round(sigma, 6).alias("sigma"), down.alias("down"), radius.alias("radius"))


def gaussian(sigma: Column, radius: Column) -> Column:
    """Normalised half kernel, weights 0..radius."""
    raw = F.transform(F.sequence(F.lit(0), radius), lambda i: F.exp(-(i * i) / (2.0 * sigma * sigma)))
    total = 2.0 * F.aggregate(raw, F.lit(0.0), lambda a, x: a + x) - 1.0
    return F.transform(raw, lambda w: w / total)


def yuv_rgb(y: Column, u: Column, v: Column) -> Column:
    """BT.601 in fixed point. The shift is arithmetic, so it floors."""
    u, v = u - 128, v - 128
    shift = lambda x: F.call_function("shiftright", x.cast("int"), F.lit(10))
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x))
    return F.struct(byte(y + shift(1436 * v)).alias("r"), byte(y - shift(352 * u + 731 * v)).alias("g"), byte(y + shift(1815 * u)).alias("b"))


def argb(color: Column) -> Column:
    """Opaque channels of a colour; 0 stands for blur and gives null."""
    part = lambda n: F.call_function("shiftright", color, F.lit(n)).bitwiseAND(F.lit(255))
    return F.when(color != 0, F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b")))


def soft_clip(x: Column) -> Column:
    """Identity up to 0.95, then a tanh knee."""
    a = F.abs(x)
    return F.when(a <= 0.95, x).otherwise(F.signum(x) * (0.95 + F.tanh((a - 0.95) / 0.05) * 0.05))


def quantized(x: Column) -> Column:
    """16-bit sample: scale 32767, round half up, clamp; not-finite counts as 0."""
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x * 32767 + 0.5))).cast("int")


def fold_down(c: list[Column]) -> tuple[Column, Column]:
    """Left and right of L, R, C, LFE, Ls, Rs; LFE is dropped."""
    w = 0.7071
    return c[0] + w * c[2] + w * c[4], c[1] + w * c[2] + w * c[5]


def span_list(text: Column) -> Column:
    """"a-b,c-d" -> array of (s, e); parts that do not parse are skipped."""
    part = F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.get(F.split(p, "-"), F.lit(0))).try_cast("long").alias("s"), F.trim(F.get(F.split(p, "-"), F.lit(1))).try_cast("long").alias("e")))
    return F.filter(part, lambda p: p["s"].isNotNull() & p["e"].isNotNull())


def vote(female_logit: Column, male_logit: Column, floor: float = 0.60) -> Column:
    """+1 male, -1 female, 0 when neither reaches the floor."""
    p = 1.0 / (1.0 + F.exp(-(male_logit - female_logit)))
    return F.when(F.greatest(p, 1.0 - p) < floor, 0).when(p >= 0.5, 1).otherwise(-1)


def thermal_pause_ms(level: Column) -> Column:
    return F.when(level >= 3, 2000).when(level == 2, 500).otherwise(0)


def schedule(low_ram: Column, total_mib: Column) -> Column:
    return F.when(~low_ram & (total_mib >= 6656), "concurrent").otherwise("sequential")


def shape(has_video: Column, long_job: Column, censor: Column, music: Column) -> Column:
    return F.when(~has_video, "audio-only").when(long_job & censor, "segmented").when(censor & music, "combined").when(music, "music").otherwise("censor")


def box_size(left: Column, top: Column, right: Column, bottom: Column) -> tuple[Column, Column]:
    return right - left, bottom - top


def upright_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height swapped for quarter turns."""
    turned = F.pmod(degrees, F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def normalized(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """A pixel box as shares of the upright picture."""
    return left / width, top / height, right / width, bottom / height


def orientation(width: Column, height: Column) -> Column:
    return F.when(width >= height, "landscape").otherwise("portrait")


def feather(distance: Column, edge: Column) -> Column:
    """1 inside the unit distance, 0 beyond it and the edge, smooth between."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + edge - distance) / edge))
    return t * t * (3 - 2 * t)


def key(column: str, name: str, kind: str) -> Column:
    """An optional key of a string map, null where it is absent or of another kind."""
    return F.try_element_at(column, F.lit(name)).try_cast(kind)


def required(value: Column, message: str) -> Column:
    """``value``, or an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(message)))


def audio_plan(readable: Column, tracks: Column, fits: Column) -> Column:
    return F.when(~readable, "transcode").when(tracks == 0, "none").when(fits, "copy").otherwise("transcode")


def finished(name: Column) -> Column:
    """Whether a file's extension is not that of an unfinished download."""
    return ~F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin("part", "ytdl", "temp")


def folder(mime: Column) -> Column:
    return F.when(mime.startswith("video/"), "Movies").otherwise("Music")


def preferred_asset(assets: Column, token: str) -> Column:
    """Link of the first package whose name holds the token, else of the first package."""
    fit = F.filter(assets, lambda a: F.lower(a["name"]).endswith(".apk") & (a["url"] != ""))
    own = F.filter(fit, lambda a: a["name"].contains(token))
    return F.coalesce(F.get(own, F.lit(0))["url"], F.get(fit, F.lit(0))["url"])


def blur_amount(amount: Column, gray: Column, solid: Column) -> Column:
    """A blur of 0 with neither gray nor solid would do nothing and becomes 25."""
    return F.when((amount == 0) & ~gray & ~solid, 25).otherwise(amount)


def scratch_bytes(duration_ms: Column, transcode: Column) -> Column:
    seconds = F.floor(duration_ms / 1000)
    return seconds * 176_400 + F.when(transcode, seconds * 24_000).otherwise(0)


def quality(name: Column) -> Column:
    return F.when(name.isin("P480", "P720", "P1080", "BEST"), name).otherwise("BEST")


def censors(censor: Column, audio_only: Column) -> Column:
    return F.when(audio_only, F.lit(False)).otherwise(censor)


def due(now: Column, last: Column, every_ms: int) -> Column:
    return now - last > every_ms


def offset_ms(pts_us: Column, start_ms: Column) -> Column:
    return F.floor(pts_us / 1000) + start_ms


def length_off(frames: Column, expected: Column) -> Column:
    """Whether two lengths differ by more than a second of samples."""
    return F.abs(frames - expected) > 44_100


def band(base: Column, span: Column, sub: Column) -> Column:
    """A step's percent mapped into its band, clamped."""
    inner = F.greatest(F.lit(0), F.least(F.lit(100), sub))
    return F.least(F.lit(100), F.greatest(F.lit(0), base + F.floor(inner * span / 100)))


def shares(*steps: tuple[Column, int]) -> Column:
    """Percent of several steps, each with its share of the whole."""
    return sum((F.floor(percent * share / 100) for percent, share in steps), F.lit(0))


def model_error(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: F.coalesce(sum((m.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return F.when(has("checksum", "sha256"), "CORRUPT").when(has("enospc", "no space left"), "LOW_SPACE").when(has("timed out", "connection", "network", "http"), "NETWORK").otherwise("GENERIC")


def inside(pts: Column, start: int, end: int) -> Column:
    return (pts >= start) & (pts < end)


def stereo(channels: Column) -> Column:
    """[left, right] of one, two or six channels."""
    c = [F.get(channels, F.lit(k)) for k in range(6)]
    left, right = fold_down(c)
    return F.when(F.size(channels) == 1, F.array(c[0], c[0])).when(F.size(channels) == 2, F.array(c[0], c[1])).otherwise(F.array(left, right))


def mono(left: Column, right: Column) -> Column:
    return 0.5 * (left + right)


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def finite_or_zero(x: Column) -> Column:
    return F.when(finite(x), x).otherwise(0.0)


def sample_pts_us(first_us: Column, samples: Column, rate: int = 44_100) -> Column:
    return first_us + F.floor(samples * 1_000_000 / rate)


def transform_grid(length: Column, hop: int = 1024) -> tuple[Column, Column, Column]:
    """Hops of a length, right padding beside a left one of 1.5 hops, and frames."""
    le = F.ceil(length / hop)
    return le, F.lit(hop // 2 * 3) + le * hop - length, le + 4


def took_text(ms: Column) -> Column:
    """``1234ms(0.0min)``: minutes are a 32-bit quotient with one digit, half up."""
    return F.format_string("%dms(%.1fmin)", ms, (ms.cast("float") / F.lit(60000.0).cast("float")).cast("float"))


def completion(state: Column, published: Column, quarantined: Column) -> list[Column]:
    """``state, discarded, may_delete`` of a job whose output is published or not."""
    return [F.when(published, "DONE").otherwise(state).alias("state"), (published & quarantined).alias("discarded"), (published & ~quarantined).alias("may_delete")]
