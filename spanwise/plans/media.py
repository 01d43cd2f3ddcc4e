"""Queries over pictures made of the bytes of the documents, and over checkpoint documents in files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions import pictures
from spanwise.session import shared_folder
from spanwise.sources import checkpoints
from spanwise.sources import fixtures as src

from .catalogue import query

# ------------------------------------------------------------------ pictures

BYTES = 384  # of a picture of 256 pixels; 16 x 16, 8 x 32, 32 x 8 or 64 x 4 by document
_WIDTHS = (16, 8, 32, 64)

_TILES = f"""hexed AS MATERIALIZED (SELECT doc_id, hex(encode(text)) AS hx FROM documents WHERE length(text) > 0),
 ti AS MATERIALIZED (SELECT doc_id, k, [16, 8, 32, 64][doc_id % 4 + 1] AS w, 256 // [16, 8, 32, 64][doc_id % 4 + 1] AS h, doc_id // 4 % 4 AS turns,
   list_transform(range(0, {BYTES}), lambda i: CASE WHEN 2 * i < length(piece) THEN CAST('0x' || substr(piece, 2 * i + 1, 2) AS INT) ELSE 32 END) AS px
   FROM (SELECT doc_id, k, substr(hx, 2 * {BYTES} * k + 1, 2 * {BYTES}) AS piece FROM (SELECT *, unnest(range(0, (length(hx) // 2 + {BYTES} - 1) // {BYTES})) AS k FROM hexed)))"""


def _yuv(rows: str, row: str, col: str) -> str:
    """CTE text: pixels ``y, u, v`` of ``rows`` (px, w, h) at source ``row``, ``col``."""
    chroma = f"px[257 + ({row}) // 2 * (w // 2) + ({col}) // 2]"
    return f"SELECT *, px[1 + ({row}) * w + ({col})] AS y, {chroma} - 128 AS u, {chroma.replace('257', '321')} - 128 AS v FROM {rows}"


_RGB = "SELECT *, greatest(0, least(255, y + ((1436 * v) >> 10))) AS r, greatest(0, least(255, y - ((352 * u + 731 * v) >> 10))) AS g, greatest(0, least(255, y + ((1815 * u) >> 10))) AS b FROM yuv"
_SUMS = "SELECT doc_id, count(DISTINCT k) AS pictures, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum((r + 2 * g + 3 * b) * (ur * 7 + uc * 3 + 1)) AS BIGINT) AS placed FROM rgb GROUP BY 1"


def _tiles(spark, d) -> DataFrame:
    """``doc_id, k, turns, width, pixels``: the bytes of every text in pieces of a picture each, the last filled up with blanks."""
    docs = src.table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    count = F.ceil(F.octet_length("raw") / BYTES).cast("int")
    rows = docs.select("doc_id", F.concat("raw", F.encode(F.repeat(F.lit(" "), BYTES), "UTF-8")).alias("raw"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    return rows.select("doc_id", "k", F.col("doc_id").alias("shape"), F.substring("raw", F.col("k") * BYTES + 1, F.lit(BYTES)).alias("pixels"))


def _summed(tiles: DataFrame, picture: Callable[[np.ndarray, int, int, int, np.ndarray], np.ndarray]) -> DataFrame:
    """Sums over the pictures of a document: of each colour, and of all by place. ``picture``: (pixels, width, height, turns, k) -> (pictures, 3, h, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k = batch.column("doc_id").to_numpy(), batch.column("k").to_numpy()
            data, starts = pictures.raw(batch.column("pixels"))
            pixels = data[starts[0] : starts[-1]].reshape(-1, BYTES)
            out = np.zeros((len(ids), 4), np.int64)
            for (width, turns), rows in pictures.by_shape(np.array(_WIDTHS)[ids % 4], ids // 4 % 4):
                made = picture(pixels[rows], width, BYTES * 2 // 3 // width, turns, k[rows]).astype(np.int64)
                place = np.arange(made.shape[2])[:, None] * 7 + np.arange(made.shape[3])[None, :] * 3 + 1
                out[rows, :3] = made.sum(axis=(2, 3))
                out[rows, 3] = ((made[:, 0] + 2 * made[:, 1] + 3 * made[:, 2]) * place).sum(axis=(1, 2))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "r": out[:, 0], "g": out[:, 1], "b": out[:, 2], "placed": out[:, 3]})

    found = tiles.select("doc_id", "k", "pixels").mapInArrow(run, "doc_id long, r long, g long, b long, placed long")
    return found.groupBy("doc_id").agg(F.count("*").alias("pictures"), *[F.sum(c).alias(c) for c in ("r", "g", "b", "placed")])


@query(f"""WITH {_TILES}, at_ AS (SELECT *, i // w AS sr, i % w AS sc FROM ti, range(0, 256) AS x(i)), yuv AS ({_yuv("at_", "sr", "sc")}), rgb_ AS ({_RGB}),
 rgb AS (SELECT *, CASE turns WHEN 0 THEN sr WHEN 1 THEN sc WHEN 2 THEN h - 1 - sr ELSE w - 1 - sc END AS ur, CASE turns WHEN 0 THEN sc WHEN 1 THEN h - 1 - sr WHEN 2 THEN w - 1 - sc ELSE sr END AS uc FROM rgb_) {_SUMS}""")
def picture_tensors(spark, d):
    """Pictures in colour, turned upright: sums of each colour and of all pixels weighted by place."""
    return _summed(_tiles(spark, d), lambda pixels, w, h, turns, k: pictures.upright(pixels, w, h, 90 * turns))


def _rects(k: np.ndarray) -> np.ndarray:
    left, top = (k % 10) / 20.0, (k % 7) / 14.0
    return np.stack([left, top, left + 0.3, top + 0.4], axis=1)


@query(f"""WITH {_TILES}, rc AS (SELECT *, (k % 10) / 20e0 AS l, (k % 7) / 14e0 AS t FROM ti), ha AS (SELECT *, greatest((l + 0.3e0 - l) * w, (t + 0.4e0 - t) * h) * 1.5e0 / 2 AS half FROM rc),
 at_ AS (SELECT *, greatest(0, least(h - 1, CAST(trunc((t + (t + 0.4e0)) / 2 * h - half + ur * half * 2 / 12) AS BIGINT))) AS sr, greatest(0, least(w - 1, CAST(trunc((l + (l + 0.3e0)) / 2 * w - half + uc * half * 2 / 12) AS BIGINT))) AS sc FROM ha, range(0, 12) AS a(ur), range(0, 12) AS c(uc)),
 yuv AS ({_yuv("at_", "sr", "sc")}), rgb AS ({_RGB}) {_SUMS}""")
def picture_crops(spark, d):
    """Squares of 12 x 12 around a rectangle of every picture."""
    return _summed(_tiles(spark, d), lambda pixels, w, h, turns, k: pictures.square_crops(pixels, w, h, _rects(k), 12))


@query(f"""WITH {_TILES}, lu AS (SELECT doc_id, k, r * 8 + c AS pos, px[1 + (r * h // 6) * w + c * w // 8] AS x FROM ti, range(0, 6) AS a(r), range(0, 8) AS b(c)),
 ch AS (SELECT doc_id, k, 48 + (r * 4 + c) * 2 + z AS pos, px[CASE z WHEN 0 THEN 321 ELSE 257 END + (2 * r * h // 6) // 2 * (w // 2) + (2 * c * w // 8) // 2] AS x FROM ti, range(0, 3) AS a(r), range(0, 4) AS b(c), range(0, 2) AS v(z))
 SELECT doc_id, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * (pos + 1)) AS BIGINT) AS placed FROM (SELECT * FROM lu UNION ALL SELECT * FROM ch) GROUP BY 1""")
def picture_packs(spark, d):
    """Every picture scaled to 8 x 6 and packed, luma first, then V and U in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, starts = pictures.raw(batch.column("pixels"))
            pixels, out = data[starts[0] : starts[-1]].reshape(-1, BYTES), np.zeros((len(ids), 2), np.int64)
            for (width,), rows in pictures.by_shape(np.array(_WIDTHS)[ids % 4]):
                made = pictures.packed(pixels[rows], width, BYTES * 2 // 3 // width, 8, 6).astype(np.int64)
                out[rows, 0], out[rows, 1] = made.sum(axis=1), (made * (np.arange(made.shape[1]) + 1)).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "total": out[:, 0], "placed": out[:, 1]})

    found = _tiles(spark, d).select("doc_id", "pixels").mapInArrow(run, "doc_id long, total long, placed long")
    return found.groupBy("doc_id").agg(F.sum("total").alias("total"), F.sum("placed").alias("placed"))


# ------------------------------------------------------------------ checkpoint documents

_SEGMENTS = "seg AS (SELECT s_suppkey AS video_id, idx, idx * 300000 AS start_ms, (idx + 1) * 300000 AS end_ms FROM supplier, range(0, 5) AS r(idx) WHERE idx <= s_suppkey % 5)"


@query(f"""WITH {_SEGMENTS} SELECT video_id, idx, start_ms, end_ms, CASE WHEN (video_id * 7 + idx) % 3 = 0 THEN 'missing' WHEN (video_id + idx) % 4 = 0 THEN 'corrupt' WHEN (video_id + idx) % 11 = 0 THEN 'other' ELSE 'done' END AS state,
 CASE WHEN (video_id * 7 + idx) % 3 <> 0 AND (video_id + idx) % 4 <> 0 THEN video_id % 3 END AS n_events FROM seg""")
def checkpoint_files(spark, d):
    """Documents of finished segments are written as files, some cut off, empty, without a field or of another plan; the plan is then resumed from what can be read."""
    folder = f"{shared_folder(spark)}/checkpoints-{uuid.uuid4().hex}"
    key, idx = F.col("video_id"), F.col("idx")
    plan = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("video_id"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("s_suppkey") % 5).cast("long"))).alias("idx"))
    plan = plan.select("video_id", "idx", (idx * 300_000).alias("start_ms"), ((idx + 1) * 300_000).alias("end_ms"))
    events = F.transform(F.sequence(F.lit(1), (key % 3).cast("int")), lambda i: F.struct((i * 1000).cast("long").alias("s"), (i * 1000 + 500).cast("long").alias("e")))
    events = F.when(key % 3 > 0, events).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
    whole = F.to_json(F.struct(F.col("start_ms").alias("startMs"), F.when((key + idx) % 11 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms")).alias("endMs"), events.alias("events")))
    harmed = F.element_at(F.array(F.substring(whole, 1, 17), F.lit(""), F.lit('{"startMs":0,"events":[]}'), F.lit('{"startMs":5,"endMs":1,"events":[]}'), F.lit('{"startMs":0,"endMs":1,"events":[{"s":1}]}')), (key % 5 + 1).cast("int"))
    body = F.when((key + idx) % 4 == 0, harmed).otherwise(whole)
    checkpoints.write(plan.where((key * 7 + idx) % 3 != 0).select("video_id", "idx", body.alias("body")), folder)
    found = checkpoints.state(plan, checkpoints.read(spark, folder))
    return found.select(*plan.columns, "state", F.size("document.events").cast("long").alias("n_events"))
