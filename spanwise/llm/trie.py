"""Operator 13: the prefix trie of conversations, by a mergesort that carries common prefixes.

A conversation is the list of its turns' digests. Tasks sort their conversations into runs, each row
with the number of turns it shares with the row before it (LCP). Rows travel to ranges of the sorted
order, where a loser tree merges the runs and compares two rows only behind the turns they are known to
share. The merged stream passes over a stack of the open path: what a row does not share with the
one before it is finished and leaves. Nodes on the outer two paths of a range may go on in the next one;
these alone are added up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

DIGEST = 32
#: Bytes of digests that a range holds, about; a longer conversation makes its range longer.
RANGE_BYTES = 8 << 20
IDS_A_PIECE = 1024
ROWS_A_BATCH = 4096
BROADCAST_BYTES = 32 << 20
HUNDRED = 100
NO_ENDS = hashlib.sha256(b"").hexdigest()

Row = tuple[bytes, int, list[int], int]  # key, conv_id, sizes of the turns, turns shared with the row before


def rebuilt(conversations: DataFrame, keep: Scratch, hundred: int = HUNDRED) -> DataFrame:
    """``conv_id, key, sizes``: each rebuilt conversation as the SHA-256 digests of its turns, one behind another, and the turns' lengths in code points.

    Conversation c takes its first h turns, h = crc32(decimal c) % 6, from conversation c - c % 100.
    Turns are in the order of ``turn``, null first; turns of one number by role, then by digest. Null
    roles and texts are empty; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("size"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    slim = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    own = keep.save(turns.groupBy("conv_id").agg(slim.alias("turns")), "turns")
    starts = own.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("_start"), F.slice("turns", 1, 5).alias("_turns"))
    n = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    start = F.coalesce(F.slice("_turns", F.lit(1), n), F.slice("turns", 1, 0))
    rest = F.slice("turns", n + 1, F.size("turns"))
    both = own.join(starts, F.col("conv_id") - F.col("conv_id") % hundred == F.col("_start"), "left").select("conv_id", F.concat(start, rest).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return keep.save(both.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "rebuilt")


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two keys share; the first ``known`` are not looked at."""
    most = min(len(a), len(b)) // DIGEST
    while known < most and a[known * DIGEST : (known + 1) * DIGEST] == b[known * DIGEST : (known + 1) * DIGEST]:
        known += 1
    return known


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of ``conv_id, key, sizes`` sorted by key and conv_id, with ``lcp``."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], ids[i]))
        lcp = [0] + [shared(keys[i], keys[j]) for i, j in zip(order, order[1:])]
        rows = batch.take(pa.array(order, pa.int64()))
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("conv_id", "key", "sizes")], pa.array(lcp, pa.int32())], ["conv_id", "key", "sizes", "lcp"])


def read_runs(batches: Iterator[pa.RecordBatch]) -> list[list[Row]]:
    """The rows that a range got, cut into runs wherever they do not ascend; a run's first row shares nothing."""
    runs: list[list[Row]] = []
    last = None
    for batch in batches:
        for key, conv, sizes, lcp in zip(*[batch.column(c).to_pylist() for c in ("key", "conv_id", "sizes", "lcp")]):
            if last is None or (key, conv) < last:
                runs.append([])
                lcp = 0
            runs[-1].append((key, conv, sizes, lcp))
            last = (key, conv)
    return runs


def merged(runs: list[list[Row]]) -> Iterator[Row]:
    """The rows of sorted runs in order, each with the turns it shares with the row before it.

    A loser tree: every loser keeps the number of turns it shares with the winner of its match. The
    next row of the winner's run shares a known number with the winner, so that both sides
    of a match are known relative to the same row: unequal numbers decide it, the larger one wins, and
    only equal ones need a comparison, behind the shared turns.
    """
    k = len(runs)
    heads: list[Row | None] = [run[0] if run else None for run in runs]
    at, share = [0] * k, [0 if run else -1 for run in runs]  # a run that has ended shares -1 and loses
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of the heads of two runs."""
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return a, b
        both = shared(x[0], y[0], share[a])
        if (x[0][both * DIGEST :], x[1]) > (y[0][both * DIGEST :], y[1]):
            a, b = b, a
        share[b] = both
        return a, b

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        row = heads[best]
        yield row[0], row[1], row[2], share[best]
        at[best] += 1
        heads[best] = runs[best][at[best]] if at[best] < len(runs[best]) else None
        share[best] = heads[best][3] if heads[best] else -1
        node = (best + k) // 2
        while node:
            best, losers[node] = match(best, losers[node])
            node //= 2


class Node:
    """A node of the open path."""

    __slots__ = ("depth", "size", "outer", "conv", "convs", "children", "leaves", "saved", "ends", "sha", "kids")

    def __init__(self, depth: int, size: int, outer: bool):
        self.depth, self.size, self.outer = depth, size, outer
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.sha, self.kids = [], None, []

    def member(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs


NODES = "kind string, range int, piece int, last boolean, id binary, parent_id binary, parent_conv_id long, conv_id long, depth long, size long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string"
_NAMES = [x.split()[0] for x in NODES.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
_SCHEMA = pa.schema([(n, _TYPES[x.split()[1]]) for n, x in zip(_NAMES, NODES.split(", "))])


def _prefix_ids(key: bytes) -> list[bytes]:
    """A name for every prefix of a key, the empty one first."""
    sha, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for i in range(0, len(key), DIGEST):
        sha.update(key[i : i + DIGEST])
        out.append(sha.copy().digest())
    return out


def nodes_of(rows: Iterator[Row], number: int) -> Iterator[dict]:
    """The nodes of a range of merged rows.

    ``inner`` nodes are whole. ``outer`` ones lie on the path of the range's first or last row and
    may have members in other ranges: they carry an id, the range's share of their figures and, as
    ``piece`` rows, the ids that end at them. A node's parent is named by its least conversation where
    the parent is inner, else by its id.
    """
    path: list[Node] = []
    first_ids: list[bytes] | None = None
    key = b""

    def base(node: Node) -> dict:
        return {"conv_id": node.conv, "depth": node.depth, "size": node.size, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.sha.hexdigest() if node.sha else NO_ENDS}

    def close(ids: list[bytes] | None, last: bool) -> Iterator[dict]:
        """Take the deepest node off the path. ``ids`` name the prefixes of an outer node."""
        node = path.pop()
        node.leaves = node.leaves if node.children else 1
        node.saved += (node.convs - 1) * node.size
        if path:
            parent = path[-1]
            parent.member(node.conv, node.convs)
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
        if ids is None:
            yield from ({**kid, "parent_conv_id": node.conv} for kid in node.kids)
            path[-1].kids.append({"kind": "inner", **base(node)})
            return
        yield from ({**kid, "parent_id": ids[node.depth]} for kid in node.kids)
        here = {"id": ids[node.depth], "range": number}
        yield {"kind": "outer", **here, "last": last, "parent_id": ids[node.depth - 1] if node.depth else None, **base(node)}
        for k in range(0, len(node.ends), IDS_A_PIECE):
            yield {"kind": "piece", **here, "piece": k // IDS_A_PIECE, "ids": ",".join(map(str, node.ends[k : k + IDS_A_PIECE]))}

    for key, conv, sizes, lcp in rows:
        outer = first_ids is None
        if outer:
            first_ids = _prefix_ids(key)
            path.append(Node(0, 0, True))
        while path[-1].depth > lcp:
            yield from close(first_ids if path[-1].outer else None, False)
        for d in range(lcp, len(sizes)):
            path.append(Node(d + 1, sizes[d], outer))
        top = path[-1]
        top.member(conv, 1)
        if top.sha is None:
            top.sha = hashlib.sha256(str(conv).encode())
        else:
            top.sha.update(f",{conv}".encode())
        top.ends.append(conv)
    if path:
        ids = _prefix_ids(key)
        while path:
            yield from close(ids, True)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in nodes_of(merged(read_runs(batches)), TaskContext.get().partitionId()):
        out.append(row)
        if len(out) == ROWS_A_BATCH:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each id; pieces of an id come one after another."""
    now, sha = None, None
    for batch in batches:
        for name, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
            if name != now:
                if sha is not None:
                    yield pa.RecordBatch.from_pydict({"_id": [now], "_sha": [sha.hexdigest()]})
                now, sha = name, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
    if sha is not None:
        yield pa.RecordBatch.from_pydict({"_id": [now], "_sha": [sha.hexdigest()]})


def _added_up(outer: DataFrame, pieces: DataFrame, keep: Scratch) -> DataFrame:
    """One row for each outer node, from its shares in all ranges.

    Sums over ranges count some things twice: a child that lies in m ranges m times, the tokens of
    a node's last text m - 1 times too little saved, and a node that is childless in a range though it
    has children in another one as a leaf. Where a range ends, the nodes that go on are a path; the corrections of
    those that go on for the first time are summed from the deepest up along it.
    """
    sums = outer.groupBy("id").agg(
        F.count("*").alias("m"), F.min("range").alias("since"), F.max("range").alias("until"), F.first("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("ends_sha256").alias("ends_sha256"), F.sum((F.col("n_children") == 0).cast("long")).alias("bare"),
    )
    sums = keep.save(sums, "outer")
    cut = sums.where("m > 1")
    twice = cut.groupBy(F.col("parent_id").alias("_id")).agg(F.sum(F.col("m") - 1).alias("_twice"))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0) - F.col("bare")
    mends = cut.select(F.col("id").alias("_id"), "since", "until", leaf.alias("leaf"), ((F.col("m") - 1) * F.col("size")).alias("more"))
    on = outer.where("last").join(mends, F.col("id") == F.col("_id")).where(F.col("range") < F.col("until"))
    upward = Window.partitionBy("range").orderBy(F.col("depth").desc())
    starts = F.col("range") == F.col("since")
    on = on.select("id", F.sum(F.when(starts, F.col("leaf")).otherwise(0)).over(upward).alias("leaf"), F.sum(F.when(starts, F.col("more")).otherwise(0)).over(upward).alias("more"))
    on = on.groupBy(F.col("id").alias("_id")).agg(F.sum("leaf").alias("_leaf"), F.sum("more").alias("_more"))
    several = pieces.join(cut.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")
    hashed = several.select("id", "range", "piece", "ids").repartition("id").sortWithinPartitions("id", "range", "piece").select("id", "ids").mapInArrow(_hashed, "_id binary, _sha string")
    out = sums
    for more in (twice, on, hashed):
        out = out.join(more, F.col("id") == F.col("_id"), "left").drop("_id")
    zero = F.lit(0)
    return out.select(
        "id", "parent_id", "conv_id", "depth", "n_convs",
        (F.col("n_children") - F.coalesce("_twice", zero)).alias("n_children"), (F.col("n_leaves") + F.coalesce("_leaf", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_more", zero)).alias("saved_tokens"),
        F.when(F.col("m") == 1, F.col("ends_sha256")).otherwise(F.coalesce("_sha", F.lit(NO_ENDS))).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES, hundred: int = HUNDRED) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Returns ``conv_id`` (the least member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``, a row for every distinct prefix, the empty one included. Nulls and
    ties are as ``rebuilt`` says; repeated rows are turns like any other. Very long texts are read whole
    by Spark's digest and length and go no further. A conversation is one row of 36 bytes a turn, so its number of turns, not their
    texts, must fit in a task. Other columns play no part. An empty table has no conversation, so no node.
    """
    spark = conversations.sparkSession
    keep = Scratch(spark, "trie")
    rows = rebuilt(conversations, keep, hundred)
    size = rows.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    runs = rows.select("conv_id", "key", "sizes").mapInArrow(runs_of, "conv_id long, key binary, sizes array<int>, lcp int")
    found = keep.save(runs.repartitionByRange(ranges, "key", "conv_id").mapInArrow(_ranges, NODES), "nodes")
    outer = keep.save(_added_up(found.where("kind = 'outer'"), found.where("kind = 'piece'"), keep), "added")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.where("kind = 'inner'")
    parents = maybe_broadcast(outer.select(F.col("id").alias("_id"), F.col("conv_id").alias("_conv")), BROADCAST_BYTES)
    known = inner.where("parent_id IS NULL").select("parent_conv_id", *columns)
    asked = inner.where("parent_id IS NOT NULL").select("parent_id", *columns).unionByName(outer.select("parent_id", *columns))
    asked = asked.join(parents, F.col("parent_id") == F.col("_id"), "left").select(F.col("_conv").alias("parent_conv_id"), *columns)
    return known.unionByName(asked).select("conv_id", "depth", "parent_conv_id", *columns[2:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Every prefix of every conversation, grouped; figures of subtrees by a join of prefixes. DuckDB has no crc32, so its bits are shifted here.
ORACLE = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS name, length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, xor(list_reduce(
        list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c) + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: CASE WHEN b > 0 THEN xor(a, b - 1) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), built AS (
    SELECT ids.conv_id, k, name, size FROM ids JOIN turns ON turns.conv_id = ids.conv_id - ids.conv_id % 100 AND k <= h
    UNION ALL SELECT ids.conv_id, k, name, size FROM ids JOIN turns ON turns.conv_id = ids.conv_id AND k > h
), seqs AS (
    SELECT conv_id, coalesce(list(name ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS s, coalesce(list(size ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS sizes FROM ids LEFT JOIN built USING (conv_id) GROUP BY conv_id
), nodes AS MATERIALIZED (
    SELECT CAST(d AS BIGINT) AS depth, s[1:d] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE min(sizes[d]) END AS size,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '') AS ends
    FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs) GROUP BY d, prefix
), kids AS MATERIALIZED (SELECT a.*, (SELECT count(*) FROM nodes b WHERE b.depth = a.depth + 1 AND b.prefix[1:a.depth] = a.prefix) AS n_children FROM nodes a)
SELECT a.conv_id, a.depth, (SELECT min(p.conv_id) FROM nodes p WHERE p.depth = a.depth - 1 AND p.prefix = a.prefix[1:a.depth - 1]) AS parent_conv_id,
    a.n_convs, a.n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM kids a JOIN kids b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix
GROUP BY ALL
"""
