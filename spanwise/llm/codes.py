"""Operator 11: vectors as short codes, by integer codebooks and partial-distance search.

Vectors become integers and are cut into parts; each part has a codebook of at most 256 entries,
improved over a few rounds. A round is one pass over a written table: every task finds the nearest
entries of its vectors and returns sums per entry, Spark adds these up, and only the codebooks (parts x
entries x width numbers, whatever the number of vectors) travel to the driver and back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
ROWS = 1024
#: Share of a part's dimensions that are summed before the first bound is taken, and share of entries left from which on these alone are carried on.
LEADING, FEW = 0.25, 0.05
BROADCAST_BYTES = 16 << 20


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book`` to each row of ``x``; ties go to the lower index.

    Dimensions are taken in descending variance of the codebook. The sum over the leading ones picks an
    entry per row whose whole distance is the first bound; from then on an entry is dropped as
    soon as its sum so far strictly exceeds the row's bound. Dropped entries stay in the array, masked, until few
    are left; then the most promising one of each row is completed, which may lower the bound, and only
    what is left is carried on. All sums are integers, so the result is exact.
    """
    n, width = x.shape
    at, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if width == 0:
        return at, far
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    largest = 2 * int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if largest * largest * width < 2**31 else np.int64  # no sum of squares leaves it
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    columns = np.ascontiguousarray(book.T)
    lead = max(1, int(width * LEADING))
    for start in range(0, n, ROWS):
        block = x[start : start + ROWS]
        sums = np.zeros((len(block), len(book)), kind)

        def completed(pick: np.ndarray, j: int, block=block, sums=sums) -> np.ndarray:
            """Whole distance of one entry per row, of which ``j`` dimensions are summed."""
            return sums[np.arange(len(block)), pick] + np.square(block[:, j:] - book[pick, j:]).sum(axis=1, dtype=kind)

        j, left, bound = 0, None, None
        while j < width and (left is None or np.count_nonzero(left) > FEW * left.size):
            step = block[:, j, None] - columns[j][None, :]
            sums += step * step
            j += 1
            if j >= lead:
                if bound is None or j % lead == 0:
                    now = completed(sums.argmin(axis=1), j)
                    bound = now if bound is None else np.minimum(bound, now)
                left = sums <= bound[:, None]
        bound = np.minimum(bound, completed(sums.argmin(axis=1), j))
        row, entry = np.nonzero(sums <= bound[:, None])
        kept = sums[row, entry]
        for d in range(j, width):
            step = block[row, d] - columns[d][entry]
            kept = kept + step * step
            alive = kept <= bound[row]
            row, entry, kept = row[alive], entry[alive], kept[alive]
        least = np.minimum.reduceat(kept, np.searchsorted(row, np.arange(len(block))))
        pick = np.flatnonzero(kept == least[row])
        pick = pick[np.unique(row[pick], return_index=True)[1]]  # entries ascend within a row
        at[start : start + ROWS], far[start : start + ROWS] = entry[pick], kept[pick]
    return at, far


@dataclass
class Codebooks:
    """``books``: parts x entries x part width, integers; ``width``: components of a vector before filling up."""

    books: np.ndarray
    width: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The components that a code stands for."""
        return [int(c) for p in range(len(self.books)) for c in self.books[p, int(code[2 * p : 2 * p + 2], 16)]][: self.width]


def integers(vector: Column, width: int) -> Column:
    """Components as floor(1024 x). They are held within a bound (1.8e5 in x for 64 components) at which no squared distance leaves 64 bits."""
    most = float(math.isqrt((2**63 - 1) // max(1, width)) // 2)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(most)), F.lit(-most))).cast("int"))


def _blocks(batch: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    """The vectors of a batch as rows x parts x part width, filled up with zeros."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)
    each = -(-width // parts)
    full = np.zeros((batch.num_rows, parts * each), np.int64)
    full[:, :width] = flat
    return full.reshape(batch.num_rows, parts, each)


def prepared(vectors: DataFrame, keep: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """The vectors that are kept, as written table ``vec_id, label, v`` of integers, and their width.

    Left out are null vectors, vectors with null or non-finite components, and vectors that are not as
    long as the first kept one (the one of the least id).
    """
    v = F.col(f"`{vector_col}`")
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).where(whole)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    width = first[0] if first else 0
    return keep.save(rows.where(F.size("v") == width).withColumn("v", integers(F.col("v"), width)), "vectors"), width


def fit(table: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a table of ``prepared``: the first vectors by id, then ``rounds`` rounds of nearest entries and floored means.

    Vectors of one id are taken in the order of their components, null ids last. With fewer vectors than
    ``entries`` the codebooks are as much shorter.
    """
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    each = -(-width // parts)
    books = np.zeros((parts, len(first), each), np.int64)
    for k, r in enumerate(first):
        books[:, k] = np.array([*r.v, *[0] * (parts * each - width)], np.int64).reshape(parts, each)
    kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def round_of(books: np.ndarray) -> DataFrame:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                x = _blocks(batch, width, parts)
                for p in range(parts):
                    at, _ = nearest(x[:, p], books[p])
                    n[p] += np.bincount(at, minlength=len(n[p]))
                    np.add.at(total[p], at, x[:, p])
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "sums": list(total[part, entry])}, kind)

        found = table.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(each)]).alias("sums"))

    for _ in range(rounds if len(first) and each else 0):
        then = books.copy()
        for r in round_of(books).collect():  # a row for each entry of a codebook at most
            then[r.part, r.entry] = [s // r.n for s in r.sums]
        books = then
    return Codebooks(books, width)


def encode(table: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of a table of ``prepared``."""
    books, width = codebooks.books, codebooks.width
    names = table.drop("v").columns
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in table.drop('v').schema)}, code string, error long"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _blocks(batch, width, len(books))
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p in range(len(books)):
                at, far = nearest(x[:, p], books[p])
                code[:, p] = at
                error += far
            text = code.tobytes().hex()
            size = 2 * len(books)
            texts = pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], texts, pa.array(error)], [*names, "code", "error"])

    return table.mapInArrow(coded, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error, label_error`` of every vector that is kept, and the codebooks.

    ``entries`` is 256 at most (two hexadecimal digits). Repeated ids keep a row each, null ids too. A
    width that ``parts`` does not divide is filled up with zeros, which add nothing to a distance. Labels
    may be null and are then equal to each other; a sum of errors beyond 64 bits is null. An empty table
    gives an empty result and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    keep = Scratch(vectors.sparkSession, "codes")
    table, width = prepared(vectors, keep, id_col, vector_col, label_col)
    codebooks = fit(table, width, parts, entries, rounds)
    coded = keep.save(encode(table, codebooks), "codes")
    sums = keep.save(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "labels")
    coded = coded.join(maybe_broadcast(sums, BROADCAST_BYTES), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return coded, codebooks


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """Every distance of every round, without bounds or orders of dimensions."""
    head = """
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
        SELECT vec_id, p AS part, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS r(p)
    ), book0 AS MATERIALIZED (
        SELECT part, entry, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256) AS seeds USING (vec_id)
    )"""
    assigned = """, near{k} AS MATERIALIZED (
        SELECT vec_id, part, first(x) AS x, min(struct_pack(d := d, entry := entry)) AS best
        FROM (SELECT vec_id, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN book{k} USING (part))
        GROUP BY vec_id, part
    )"""
    moved = """, mean{n} AS (
        SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
        FROM (SELECT part, best.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, range(1, 1000) AS g(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY part, entry
    ), book{n} AS MATERIALIZED (
        SELECT book{k}.part, book{k}.entry, coalesce(mean{n}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{n} ON book{k}.part = mean{n}.part AND book{k}.entry = mean{n}.entry
    )"""
    steps = "".join(assigned.format(k=k) + moved.format(k=k, n=k + 1) for k in range(rounds)) + assigned.format(k=rounds)
    tail = f""", coded AS (
        SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""
    return head + steps + tail


ORACLE = _oracle()
