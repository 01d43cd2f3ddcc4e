"""Operator 1: token shards in training order, with fixed stride, placed by a Feistel permutation."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .feistel import permute
from .scratch import Scratch
from .sized import maybe_broadcast
from .textcore import blocks, buffers

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "\u2581"
CACHED_WORDS = 600_000
#: Tokens of a stored run, bytes of text encoded at once, shards that one task writes at most.
RUN, BLOCK, TASK_SHARDS = 1 << 18, 1 << 20, 16
#: A row per input partition is sent to every executor up to this size, else joined by shuffling.
STARTS_BYTES = 64 << 20
_loaded: dict[str, object] = {}


class _Words(dict):
    """Ids of units between spaces as uint16 bytes, encoded when first met; a bounded cache per worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.model.vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids need more than 16 bits")
        self.end = np.array([self.model.eos_id()], dtype=np.uint16).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text), dtype=np.uint16).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[unit] = self.whole(unit)
        return ids

    def learn(self, texts: list[list[str]]) -> None:
        """Encode what is new in one call; units of texts that are encoded whole do no harm."""
        new = list({u for units in texts for u in units if u not in self})
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
        self.update(zip(new, (np.array(ids, dtype=np.uint16).tobytes() for ids in self.model.encode(new, num_threads=1)), strict=True))

    def ids(self, text: str, units: list[str]) -> np.ndarray:
        parts = [self.whole(text)] if "" in units else [*map(self.__getitem__, units)]
        parts.append(self.end)
        return np.frombuffer(b"".join(parts), dtype=np.uint16)


def encode(texts: list[str], tokenizer: str) -> list[np.ndarray]:
    """uint16 ids of each text and an end mark. ``bytes``: UTF-8 bytes and 256; else a sentencepiece model's path.

    A model's pieces begin at spaces and never cross one, so a text is the ids of its units between
    spaces in order. Texts with spaces in a row or at an end, and those that hold the mark which
    stands for a space inside models, are encoded whole.
    """
    if tokenizer == "bytes":
        return [np.append(np.frombuffer(t.encode(), dtype=np.uint8).astype(np.uint16), np.uint16(256)) for t in texts]
    if tokenizer not in _loaded:
        _loaded[tokenizer] = _Words(tokenizer)
    split = [[""] if SPACE_MARK in t else t.split(" ") for t in texts]
    _loaded[tokenizer].learn(split)
    return [*map(_loaded[tokenizer].ids, texts, split)]


def _tokens(tokenizer: str):
    """Texts to runs of at most RUN tokens: the partition, tokens before the run in it, the ids compressed."""
    target = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codec, before, held, size = TaskContext.get().partitionId(), pa.Codec("zstd", compression_level=6), 0, [], 0

        def runs() -> Iterator[pa.RecordBatch]:
            nonlocal before
            ids = np.concatenate(held)
            for i in range(0, len(ids), RUN):
                run = ids[i : i + RUN]
                yield pa.RecordBatch.from_pydict({"part": [part], "before": [before], "n": [len(run)], "ids": [codec.compress(run.tobytes(), asbytes=True)]}, schema=target)
                before += len(run)

        for batch in batches:
            _, offsets = buffers(batch.column(0))
            for i, j in blocks(offsets, BLOCK):
                for ids in encode([t or "" for t in batch.column(0).slice(i, j - i).to_pylist()], tokenizer):
                    held.append(ids)
                    size += len(ids)
                    if size >= RUN:
                        yield from runs()
                        held, size = [], 0
        if held:
            yield from runs()

    return apply


def _pieces(length: int, count: int, key: int):
    """Runs to pieces of sequences: the sequence's slot, where in it the piece begins, its ids."""
    target = pa.schema([("slot", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for start, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(codec.decompress(packed.as_buffer(), decompressed_size=2 * n), dtype="<u2")
                edges = np.unique(np.concatenate(([0], np.arange(-start % length, n, length), [n])))
                at, size = start + edges[:-1], np.diff(edges)
                pieces = [codec.compress(ids[a:b].tobytes(), asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                slots = permute(at // length, count, key)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((at % length).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(pieces, pa.binary())], schema=target)

    return apply


def _store(out: str, length: int, per_shard: int, count: int, pad: int):
    from pyarrow import fs

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        codec = pa.Codec("zstd")
        shard, data, filled = -1, None, 0

        def close() -> pa.RecordBatch:
            raw = data.tobytes()
            path = f"{base}/shard-{shard:08d}.bin"
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(raw)
            store.move(part, path)  # whole files only; a second attempt writes the same bytes
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "first_slot": pa.array([shard * per_shard], pa.int64()), "slots": pa.array([len(data)], pa.int64()), "tokens": pa.array([filled], pa.int64()), "bytes": pa.array([len(raw)], pa.int64()), "sha256": [hashlib.sha256(raw).hexdigest()]})

        for batch in batches:
            for slot, at, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if slot // per_shard != shard:
                    if data is not None:
                        yield close()
                    shard, filled = slot // per_shard, 0
                    data = np.full((min(per_shard, count - shard * per_shard), length), pad, dtype="<u2")
                data[slot - shard * per_shard, at : at + n] = np.frombuffer(codec.decompress(ids.as_buffer(), decompressed_size=2 * n), dtype="<u2")
                filled += n
        if data is not None:
            yield close()

    return apply


def write_shards(docs: DataFrame, out: str, tokenizer: str = TOKENIZER, length: int = 2048, per_shard: int = 2048, key: int = 1, pad: int = 0, text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token shards below ``out`` and return their manifest.

    The texts' tokens, an end mark after each, are one stream in the order of the input's
    partitions; sequence s is its s-th run of ``length`` tokens. Sequence s goes to slot
    permute(s). Slot t is row t % per_shard of file shard-(t // per_shard): ``length`` ids of
    two little-endian bytes. So any slot is one seek, and a reader resumes at any slot.

    Every text is tokenized once, into a table in the shared folder that fixes the stream's order;
    counts per partition and the pieces of sequences are taken from it, so a task that runs
    again finds the same tokens. Only the total comes to the driver. Shards are written whole and
    renamed, so a lost executor leaves no half file.

    Manifest: ``shard, first_slot, slots, tokens, bytes, sha256``. The last sequence is filled up
    with ``pad``. Null or empty texts give an end mark. Very long texts are stored in runs and cut
    into sequences like any other. Repeated rows count each. An empty table gives no shards.
    Other columns play no part.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "tokens")
    runs = keep.save(docs.select(F.col(text_col).cast("string")).mapInArrow(_tokens(tokenizer), "part int, before long, n int, ids binary"), "runs")
    parts = runs.groupBy("part").agg(F.sum("n").alias("_n"))  # a row per partition of the input
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep.save(parts.select(F.col("part").alias("_part"), "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")), "starts")
    count = -(-(starts.agg(F.sum("_n")).first()[0] or 0) // length)
    placed = runs.join(maybe_broadcast(starts, STARTS_BYTES), F.col("part") == F.col("_part")).select(F.col("_start") + F.col("before"), "n", "ids")
    pieces = placed.mapInArrow(_pieces(length, count, key), "slot long, at int, n int, ids binary")
    shards = max(1, -(-count // per_shard))
    each = min(TASK_SHARDS, max(1, shards // (2 * spark.sparkContext.defaultParallelism)))
    # slots are dense and evenly filled, so the ranges are known: no sampling pass over the tokens
    pieces = pieces.repartitionById(-(-shards // each), F.floor(F.col("slot") / (per_shard * each)).cast("int")).sortWithinPartitions("slot", "at")
    pieces.mapInArrow(_store(out, length, per_shard, count, pad), "shard long, first_slot long, slots long, tokens long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{out}/_manifest")
    return spark.read.parquet(f"{out}/_manifest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "shards").path("out"))
