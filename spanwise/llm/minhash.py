"""Operator 10: near-duplicate documents by SuperMinHash, banding, verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .graph import components
from .scratch import Scratch
from .sized import maybe_broadcast

SLOTS = 252
BLOCK = 1 << 21
#: A block's rows and shingles, on average.
GROUP, GROUP_SHINGLES = 1024, 1 << 21
GONE_BYTES = 16 << 20
EMPTY = np.uint64(tc.MASK)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size``-word shingles per text, sorted, and each text's start (+ 1 entry).

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    starts, ends, first = tc.words(data, offsets)
    each = tc.hashes(data, starts, ends, lower=True)
    n_words = np.diff(first)
    out, cut = [], np.zeros(len(n_words) + 1, dtype=np.int64)
    runs = tc.windows(each, size) if len(each) >= size else np.zeros(0, np.uint64)
    for i, n in enumerate(n_words):
        if n >= size:
            own = np.sort(runs[first[i] : first[i] + n - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = tc.windows(each[first[i] : first[i + 1]], int(n)) ^ np.uint64(0x5851F42D4C957F2D * int(n) & tc.MASK)
        else:
            own = runs[:0]
        out.append(own)
        cut[i + 1] = cut[i] + len(own)
    return (np.concatenate(out) if out else runs[:0]), cut


def superminhash(elements: np.ndarray, cut: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, one row per set: SuperMinHash values as rank << 56 | fraction.

    Every element draws a random permutation of the slots one place at a time (Fisher-Yates,
    seeded by the element); what it offers to the slot in place j is j plus a fraction. Rounds
    go over j for all elements of all sets at once. As a value from an earlier round is always
    smaller, a set leaves as soon as each of its slots has a value.
    """
    n = len(cut) - 1
    table = np.full(n * slots, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(cut))
    own, drawn, places = elements, [], None
    for j in range(slots):
        if not len(own):
            break
        fraction = tc.mix(own + np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & tc.MASK))
        pick = np.uint64(j) + (tc.mix(own ^ np.uint64((0xD1342543DE82EF95 * (2 * j + 1)) & tc.MASK)) >> np.uint64(32)) % np.uint64(slots - j)
        pick = pick.astype(np.int64)
        if places is None and j < 8:  # follow the few swaps back instead of keeping whole permutations
            slot = pick.copy()
            for t in range(j - 1, -1, -1):
                was, here = slot == drawn[t], slot == t
                slot[here] = drawn[t][here]
                slot[was] = t
            drawn.append(pick)
        else:
            rows = np.arange(len(own))
            if places is None:
                places = np.tile(np.arange(slots, dtype=np.int16), (len(own), 1))
                for t, k in enumerate(drawn):
                    places[rows, t], places[rows, k] = places[rows, k], places[rows, t].copy()
            slot = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[:, j]
            places[:, j] = slot
        np.minimum.at(table, owner * slots + slot, np.uint64(j << 56) | (fraction >> np.uint64(8)))
        short = (table.reshape(n, slots) == EMPTY).any(axis=1)
        live = short[owner]
        if not live.all():
            own, owner, drawn = own[live], owner[live], [d[live] for d in drawn]
            if places is not None:
                places = places[live]
    return table.reshape(n, slots)


def rows_per_band(threshold: float, slots: int = SLOTS, miss: float = 5e-6) -> int:
    """The longest bands with which a pair at the threshold is missed with probability < miss."""
    return max([r for r in range(1, 17) if (1 - threshold**r) ** (slots // r) <= miss], default=1)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int) -> DataFrame:
    """``id, n, d1, d2, sig, bands`` per document: set size, 128-bit set digest, one byte per slot, band keys."""
    schema = "id long, n long, d1 long, d2 long, sig binary, bands array<long>"
    target = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.buffers(batch.column(1))
            for i, j in tc.blocks(offsets, BLOCK):
                sets, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                n = np.diff(cut)
                full = n > 0
                dense = np.concatenate(([0], np.cumsum(n[full])))
                table = superminhash(sets, dense)
                d = np.zeros((2, j - i), dtype=np.uint64)
                if len(table):
                    d[0, full] = np.add.reduceat(tc.mix(sets ^ np.uint64(tc.WINDOW_A)), dense[:-1])
                    d[1, full] = np.add.reduceat(tc.mix(sets ^ np.uint64(tc.WINDOW_B)), dense[:-1])
                bands = table.shape[1] // rows
                keys = np.zeros((len(table), bands), dtype=np.uint64)
                for k in range(rows):
                    keys = tc.mix(keys * np.uint64(tc.BASE_B) + table[:, k : bands * rows : rows])
                keys = tc.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(tc.BASE_A))
                small = (tc.mix(table) >> np.uint64(56)).astype(np.uint8)
                sigs = np.full(j - i, None, dtype=object)
                sigs[full] = [row.tobytes() for row in small]
                ends = np.zeros(j - i + 1, dtype=np.int32)
                np.cumsum(np.where(full, bands, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(tc.signed(d[0])), pa.array(tc.signed(d[1])), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(ends, tc.signed(keys.ravel()))],
                    schema=target,
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(apply, schema)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Those of ``a, b`` whose full shingle sets satisfy 100 * intersection >= percent * union."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, at = tc.buffers(batch.column(2))
            right, bt = tc.buffers(batch.column(3))
            for i, j in tc.blocks(at + bt, BLOCK):
                x, xc = shingle_sets(left[at[i] : at[j]], at[i : j + 1] - at[i], size)
                y, yc = shingle_sets(right[bt[i] : bt[j]], bt[i : j + 1] - bt[i], size)
                good = np.zeros(j - i, dtype=bool)
                for k in range(j - i):
                    good[k] = linked(x[xc[k] : xc[k + 1]], y[yc[k] : yc[k + 1]], percent)
                part = batch.slice(i, j - i).select([0, 1])
                yield part.filter(pa.array(good))

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t")).where("_id is not null and _t is not null")
    wide = (
        pairs.select("a", "b")
        .join(texts.select(F.col("_id").alias("a"), F.col("_t").alias("_ta")), "a")
        .join(texts.select(F.col("_id").alias("b"), F.col("_t").alias("_tb")), "b")
        .select("a", "b", "_ta", "_tb")
    )
    return wide.mapInArrow(apply, "a long, b long")


def packed_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, shingles``: the sorted shingle hashes of a text as bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.buffers(batch.column(1))
            for i, j in tc.blocks(offsets, BLOCK):
                sets, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                rows = [sets[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())], names=["id", "shingles"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(apply, "id long, shingles binary")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets satisfy 100 * intersection >= percent * union."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q), 1):
        return False
    both = np.concatenate((p, q))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(p) + len(q) - common)


def _bridges(least: float, percent: int):
    """Verified links between components inside one pair of blocks, at most one per merge."""

    def apply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.block == key[1]], rows[rows.block == key[2]]
        if left.empty or right.empty:  # few rows over many blocks, as with very long texts
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        other = np.frombuffer(b"".join(right.sig), dtype=np.uint8).reshape(len(right), -1)
        ids, comps, sizes = right.id.to_numpy(), right.comp.to_numpy(), right.n.to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in right.shingles]
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        found = []
        for a, comp, n, sig, shingles in zip(left.id, left.comp, left.n, left.sig, left.shingles, strict=True):
            may = (comps != comp) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            if key[1] == key[2]:
                may &= ids > a
            at = np.flatnonzero(may)
            at = at[(other[at] == np.frombuffer(sig, dtype=np.uint8)).mean(axis=1) >= least]
            own = np.frombuffer(shingles, dtype=np.uint64)
            for k in at:
                x, y = top(comp), top(int(comps[k]))
                if x != y and linked(own, sets[k], percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((min(a, ids[k]), max(a, ids[k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return apply


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts are lower-cased (A-Z), split on ASCII white space and taken as sets of distinct
    ``size``-word shingles. Documents with 100 * intersection >= percent * union are linked;
    a component is what links reach, named by its smallest id; that document is kept.

    Null and empty texts: n_shingles 0, linked with nothing, kept. Very long texts are hashed in
    pieces and compared whole. Rows that share an id are one document with several texts. A null
    id: never linked, component null, kept. Ids that are not whole numbers get numbers for the
    work and their least in place of a component's number. An empty table gives an empty table;
    other columns play no part.
    """
    if _whole(docs, id_col):
        return _classes(docs, percent, size, id_col, text_col).withColumnsRenamed({"id": "doc_id", "n": "n_shingles", "component": "component_id"})
    keep = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_col).alias("_name"), F.col(text_col).cast("string").alias("_text"))
    numbers = keep.save(rows.select("_name").where("_name is not null").distinct().withColumn("_number", F.monotonically_increasing_id()), "numbers")
    rows = rows.join(numbers.withColumnRenamed("_name", "_n"), F.col("_name") == F.col("_n"), "left").select("_name", "_text", "_number")
    found = keep.save(_classes(rows, percent, size, "_number", "_text"), "classes")
    least = found.join(numbers, F.col("id") == F.col("_number")).groupBy(F.col("component").alias("_c")).agg(F.min("_name").alias("component_id"))
    out = found.join(numbers, F.col("id") == F.col("_number"), "left").join(least, F.col("component") == F.col("_c"), "left")
    return out.select(F.col("_name").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("_name") == F.col("component_id"), F.lit(True)).alias("kept"))


def _whole(docs: DataFrame, id_col: str) -> bool:
    return docs.select(id_col).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")


def _classes(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, component, kept`` for every row; ids are whole numbers.

    1. One pass makes SuperMinHash signatures and set digests. Equal sets are one node.
    2. Nodes that share a band are compared with the band's smallest node on their full sets.
    3. In bands whose nodes are not all connected by then, nodes of different components are
       compared by signature, in pairs of blocks of bounded rows and bytes. What may reach the
       threshold (estimate within six standard errors) is verified there on full sets, and only
       links that join two components leave the block: as many rows as there are merges.

    A pair at the threshold shares no band with probability under 5e-6, and one that does is
    passed over by its estimate with probability under 4e-7 (Chernoff); nothing is capped.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "minhash")
    rows = rows_per_band(percent / 100)
    sk = keep.save(sketches(docs, id_col, text_col, size, rows), "sketches")
    groups = sk.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    groups = keep.save(groups, "groups")
    nodes = sk.join(groups.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi")
    banded = nodes.where("n > 0").select("id", "n", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("members"), F.sum("n").alias("weight"), F.max("id").alias("_last")).where("head <> _last").drop("_last")
    shared = keep.save(banded.drop("n").join(heads, "band"), "bands")
    stars = keep.save(shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = keep.save(verified(stars, docs, id_col, text_col, size, percent), "links")
    comps = keep.save(components(links, keep), "components")

    # bands with three nodes or more that are not all in one component
    placed = shared.where("members > 2").join(comps.select(F.col("id").alias("_id"), "component"), F.col("id") == F.col("_id"), "left").select("band", "id", "members", "weight", F.coalesce("component", "id").alias("comp"))
    parted = placed.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_all"), F.bit_xor(F.xxhash64("id")).alias("_xor")).where("_lo <> _hi")
    parted = parted.groupBy("_all", "_xor").agg(F.min("band").alias("band")).select("band")  # one band of those with the same nodes
    open_rows = keep.save(placed.join(parted, "band", "left_semi"), "open")
    wanted = keep.save(open_rows.select(F.col("id").alias("_id")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).join(wanted, F.col("id") == F.col("_id"), "left_semi")
    open_rows = open_rows.join(nodes.select("id", "n", "sig"), "id").join(packed_sets(texts, "id", "_text", size), "id")
    blocks = F.greatest(F.ceil(F.col("members") / GROUP), F.ceil(F.col("weight") / GROUP_SHINGLES))
    blocked = open_rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    blocked = blocked.select("band", F.least("block", "_o").alias("b1"), F.greatest("block", "_o").alias("b2"), "block", "id", "comp", "n", "sig", "shingles")
    t = percent / 100
    least = t - 6 * (t * (1 - t) / SLOTS) ** 0.5
    more = keep.save(blocked.groupBy("band", "b1", "b2").applyInPandas(_bridges(least, percent), "a long, b long").distinct(), "bridges")
    if not more.isEmpty():
        edges = comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        comps = keep.save(components(edges, keep), "components")

    named = groups.join(comps, F.col("rep") == F.col("id"), "left").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("component", "rep").alias("component"))
    out = sk.select("id", "n", "d1", "d2").join(named, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select("id", "n", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of least id; all columns stay, whatever they are called.

    Null and empty texts are in no group and stay. Where ids repeat, are null or are not whole
    numbers, rows are first written with a number of their own: then every row is judged by its
    text, equal rows included, ids only say which row of a group stays (a null id last). An empty
    table gives an empty table.
    """
    keep = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    if _whole(docs, id_col) and rows.groupBy("_id").count().where("count > 1 or _id is null").isEmpty():
        gone = _classes(rows, percent, size, "_id", "_text").where("not kept").select(F.col("id").alias("_gone"))
        number = "_id"
    else:
        rows, number = keep.save(rows.withColumn("_number", F.monotonically_increasing_id()), "rows"), "_number"
        found = keep.save(_classes(rows, percent, size, "_number", "_text").where("n > 0"), "classes")
        named = found.join(rows.select(F.col("_number").alias("_m"), "_id"), F.col("id") == F.col("_m"))
        stays = named.groupBy(F.col("component").alias("_c")).agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("name"), F.col("id").alias("row"))).alias("_first"))
        gone = found.join(stays, F.col("component") == F.col("_c")).where(F.col("id") != F.col("_first.row")).select(F.col("id").alias("_gone"))
    gone = keep.save(gone, "gone")
    return rows.join(maybe_broadcast(gone, GONE_BYTES), F.col(number) == F.col("_gone"), "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


#: No sketches: every pair of documents with a common shingle, and what links reach; ``percent`` is 85.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT a, a AS b FROM sym UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON doc_id = a
"""
