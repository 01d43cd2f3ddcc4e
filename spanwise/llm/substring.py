"""Operator 2: removal of repeated word runs by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .scratch import Scratch

#: Perfect difference sets: every residue modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}
LEAST_ANCHOR = 10
BLOCK = 1 << 21


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, residues, anchor width): any two equal windows share an anchor at one offset.

    For starts i and j there is an offset below the period at which both are at cover
    positions; an anchor of window - period + 1 words from there lies inside both windows.
    """
    period = max([p for p in COVERS if window - p + 1 >= min(LEAST_ANCHOR, window - 2)], default=0)
    if not period:
        return 1, (0,), window
    return period, COVERS[period], window - period + 1


class _Block:
    """Words of some texts and where their anchors are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.offsets, self.window = data, offsets, window
        self.period, residues, self.width = cover(window)
        self.starts, self.ends, self.first = tc.words(data, offsets)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.local = np.arange(len(self.starts)) - self.first[:-1][self.text]
        at = np.zeros(self.period, dtype=bool)
        at[list(residues)] = True
        self.anchored = at[self.local % self.period] & (self.local + self.width <= self.n[self.text])

    def hashes(self, size: int, word_base: int, base: int) -> np.ndarray:
        return tc.windows(tc.hashes(self.data, self.starts, self.ends, word_base), size, base)

    def candidates(self, alone: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor which is repeated somewhere; ``alone``: those that are not."""
        repeated = self.anchored.copy()
        repeated[alone] = False
        p = np.flatnonzero(repeated)
        base, n = self.first[:-1][self.text[p]], self.n[self.text[p]]
        low, high = np.maximum(p - self.period + 1, base), np.minimum(p, base + n - self.window)
        return self.marked(low[high >= low], high[high >= low] + 1)

    def marked(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Positions inside any of the ranges [low, high)."""
        step = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.add.at(step, low, 1)
        np.add.at(step, high, -1)
        return np.cumsum(step)[:-1] > 0

    def placed(self, lists: pa.Array) -> np.ndarray:
        """Positions in the block of a list column of positions in each text."""
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return flat + np.repeat(self.first[:-1], sizes)


def _each(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    for batch in batches:
        data, offsets = tc.buffers(batch.column(1))
        for i, j in tc.blocks(offsets, BLOCK):
            yield batch.slice(i, j - i), _Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they are to be shuffled, and their sizes."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        data, offsets = tc.buffers(batch.column(1))
        rows = [codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(rows, pa.binary())], names=["id", "size", "packed"])


def _each_packed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    """Like ``_each`` for columns id, size, packed, ..."""
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        for i, j in tc.blocks(offsets, BLOCK):
            texts = [pa.decompress(z.as_py(), decompressed_size=int(n), codec="zstd", asbytes=True) if n else b"" for z, n in zip(batch.column(2).slice(i, j - i), sizes[i:j], strict=True)]
            yield batch.slice(i, j - i), _Block(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets[i : j + 1] - offsets[i], window)


def _anchors(window: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _each(batches, window):
            at = np.flatnonzero(block.anchored)
            if len(at):
                key = block.hashes(block.width, tc.BASE_A, tc.WINDOW_A)[at]
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(key)), rows.column(0).take(pa.array(block.text[at])), pa.array(block.local[at].astype(np.int32))], names=["h", "id", "pos"])

    return apply


def _windows(window: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _each_packed(batches, window):
            at = np.flatnonzero(block.candidates(block.placed(rows.column(3))))
            if len(at):
                one, two = block.hashes(window, tc.BASE_A, tc.WINDOW_A)[at], block.hashes(window, tc.BASE_B, tc.WINDOW_B)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tc.signed(one)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), rows.column(0).take(pa.array(block.text[at])), pa.array(block.local[at].astype(np.int32))],
                    names=["h1", "h2", "id", "pos"],
                )

    return apply


def _removed(window: int, with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _each_packed(batches, window):
            starts = block.candidates(block.placed(rows.column(3)))
            starts[block.placed(rows.column(4))] = False
            s = np.flatnonzero(starts)
            gone = block.marked(s, s + window)
            total = np.concatenate(([0], np.cumsum(gone)))
            lost = total[block.first[1:]] - total[block.first[:-1]]
            texts, digests = [], []
            for k in range(rows.num_rows):
                parts = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes().split()
                if lost[k]:
                    parts = [w for w, g in zip(parts, gone[block.first[k] : block.first[k + 1]].tolist(), strict=True) if not g]
                text = b" ".join(parts)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            columns = [rows.column(0), pa.array(block.n), pa.array(lost), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return apply


def alone(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per id, the positions whose key is seen exactly once anywhere.

    One aggregation that combines before the shuffle: where the count is one, the least id and
    the least position are those of the only row. No join, and no group is ever gathered.
    """
    once = rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min("id").alias("id"), F.min("pos").alias("pos")).where("c = 1")
    return once.groupBy("id").agg(F.collect_list("pos").alias(name))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also starts elsewhere.

    1. Anchors: runs of window - period + 1 words, hashed at cover positions only.
    2. Windows around anchors that are repeated anywhere are hashed whole (96 bits).
    3. Windows whose hash is seen once are set aside; the words of all others go.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` (+ ``kept_text``). Texts with fewer than
    ``window`` words lose nothing; very long texts are worked on in pieces of words and whole as
    strings. Null text: no words. Repeated rows are repeats of each other; repeated or null ids,
    and ids that are not whole numbers, keep a row each. An empty table gives an empty table;
    other columns play no part.
    """
    slim = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    unique = slim.schema[0].dataType.typeName() in ("byte", "short", "integer", "long") and slim.groupBy("_doc").count().where("count > 1 or _doc is null").isEmpty()
    if unique:
        base = slim.select(F.col("_doc").cast("long").alias("id"), "text")
    else:  # rows need names of their own, fixed by writing them
        slim = Scratch(docs.sparkSession, "substring").save(slim.withColumn("id", F.monotonically_increasing_id()), "rows")
        base = slim.select("id", "text")
    some = F.array().cast("array<int>")
    anchors = base.mapInArrow(_anchors(window), "h long, id long, pos int")
    # docs meet their singles by id; the shuffled, compressed texts serve both joins
    texts = base.mapInArrow(_packed, "id long, size long, packed binary")
    first = texts.join(alone(anchors, ["h"], "lone_anchors"), "id", "left").select("id", "size", "packed", F.coalesce("lone_anchors", some).alias("lone_anchors"))
    windows = first.mapInArrow(_windows(window), "h1 long, h2 int, id long, pos int")
    second = first.join(alone(windows, ["h1", "h2"], "lone_windows"), "id", "left").select("id", "size", "packed", "lone_anchors", F.coalesce("lone_windows", some).alias("lone_windows"))
    out = second.mapInArrow(_removed(window, with_text), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    if unique:
        return out.withColumn("id", F.col("id").cast(slim.schema[0].dataType)).withColumnRenamed("id", "doc_id")
    return out.join(slim.select("id", F.col("_doc").alias("doc_id")), "id").select("doc_id", *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM g, (SELECT unnest(range(0, 35)) AS k) WHERE n > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
