"""Vector codes, exact duplicates and the prefix trie against definitions written out in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import codes, exact, trie
from spanwise.llm.scratch import Scratch

# vector codes


def plain_codes(rows, entries=256, rounds=4):
    """rows: (vec_id, components, label); ids may repeat or be None."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    each = -(-len(ok[0][1]) // 4)
    ints = [[math.floor(1024 * x) for x in r[1]] + [0] * (4 * each - len(r[1])) for r in ok]
    cut = lambda v, p: v[p * each : (p + 1) * each]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(4)]

    def at(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for v in ints:
                members[at(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out, by_label = [], defaultdict(int)
    for r, v in zip(ok, ints):
        found = [at(cut(v, p), books[p]) for p in range(4)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
        by_label[r[2]] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[lab]) for i, c, e, lab in out], key=str), sha


def spark_codes(spark, rows, kind="float", **more):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("v", F.lit(1)).withColumn("_label", F.lit("x"))
    out, books = codes.compress(table.repartition(3), **more)
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in out.collect()], key=str), books


@pytest.mark.parametrize("width, n, entries, spread", [(8, 60, 256, 1.0), (16, 400, 32, 0.01), (10, 90, 16, 3.0), (1, 40, 8, 1.0), (64, 300, 20, 0.2)])
def test_codes(spark, width, n, entries, spread):
    rng = random.Random(width)
    rows = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * width, 1), (n + 2, [float("inf"), *[0.0] * (width - 1)], None), (n + 3, [None, *[0.0] * (width - 1)], 2)]
    rows += [rows[3], rows[3], (None, rows[4][1], 2), (7, [0.5] * width, 1), (n + 4, [1.0] * (width + 1), 1)]  # repeated and null ids, another width
    got, books = spark_codes(spark, rows, entries=entries)
    want, sha = plain_codes(rows, entries)
    assert got == want and books.sha256() == sha


def test_codes_of_few_and_none(spark):
    assert spark_codes(spark, [])[0] == []
    assert spark_codes(spark, [(1, None, 1), (2, [float("nan")], 1)])[0] == []
    got, books = spark_codes(spark, [(5, [0.25, -0.25, 1.5, -0.0], None)], "double")
    assert got == [(5, "00000000", 0, 0)] and books.decode("00000000") == [256, -256, 1536, 0]
    assert spark_codes(spark, [(1, [], 1), (2, [], 1)])[0] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    got, _ = spark_codes(spark, [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [0.0, 0.0, 0.0, 1.0], 1)])  # held within the bound
    assert [g[:3] for g in got] == [(1, "00000000", 0), (2, "01010000", 0)] or all(g[2] >= 0 for g in got)
    with pytest.raises(ValueError):
        spark_codes(spark, [(1, [1.0], 1)], entries=300)


@pytest.mark.parametrize("n, k, width, most", [(500, 256, 16, 3), (300, 7, 5, 1), (200, 1, 3, 9), (64, 300, 2, 2), (50, 20, 33, 1 << 25)])
def test_nearest(n, k, width, most):
    """Small numbers make many ties; equal entries too."""
    rng = np.random.default_rng(n)
    x, book = rng.integers(-most, most + 1, (n, width)), rng.integers(-most, most + 1, (k, width))
    book[k // 2] = book[0]
    at, far = codes.nearest(x, book)
    all_far = np.square(x[:, None] - book[None]).sum(axis=2)
    assert (at == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()


# exact duplicates

BLANKS = re.compile("[\x20\x09-\x0d]+")


def body(text):
    return BLANKS.sub(" ", text or "")


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[body(text)].append(i)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        out += [(i, min(named) if named else None, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def texts(rng, n):
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "", None, "x" * 50_000, "x" * 50_000 + " ", "é b", "é b"]) if rng.random() < 0.7 else f"t{rng.randrange(n)}") for i in range(n)]
    return rows + [(None, "a b"), (None, "alone"), (None, "alone"), (3, "a b"), (3, "three"), (3, "three"), (3, "  three")]


def write(spark, rows, path, files=3):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("f")).withColumn("_metadata", F.lit(1)).withColumn("digest", F.lit(0)).repartition(files).write.parquet(str(path))
    return str(path)


@pytest.mark.parametrize("weak", [None, 1, 0])
def test_exact(spark, tmp_path, weak):
    """``weak``: digests of so many letters, so that different texts share them and only their bytes tell them apart."""
    rows = texts(random.Random(12), 120)
    path = write(spark, rows, tmp_path / "docs")
    how = {} if weak is None else {"digest": lambda t: F.substring(F.sha2(t, 256), 1, weak)}
    got = exact.report(spark, path, **how).collect()
    want = plain_groups(rows)
    sha = {(r.file, r.row): hashlib.sha256(r.body.encode()).hexdigest() for r in exact.Seen(spark, str(tmp_path)).texts(path).collect()}
    assert sorted([(r.id, r.keep_id, r.group_size, sha[r.file, r.row]) for r in got], key=str) == want
    kept = [(sha[r.file, r.row], r.id) for r in got if r.kept]
    assert len(kept) == len({s for s, _ in kept}) == len({w[3] for w in want})
    assert {(s, i) for s, i in kept} == {(w[3], w[1]) for w in want}


def test_exact_copies_of_one_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "ROWS_A_COPY", 5)
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"other {i // 2}") for i in range(40)]
    got = exact.report(spark, write(spark, rows, tmp_path / "docs")).collect()
    assert sorted([(r.id, r.keep_id, r.group_size) for r in got]) == sorted([(i, 0, 300) for i in range(300)] + [(1000 + i, 1000 + i // 2 * 2, 2) for i in range(40)])


def test_exact_deliveries(spark, tmp_path):
    """Texts that arrive one folder after another meet the state of earlier ones; a delivery that is run again counts once."""
    rows = texts(random.Random(5), 90)
    parts = [write(spark, rows[k::3], tmp_path / f"d{k}", 2) for k in range(3)]
    seen = exact.Seen(spark, str(tmp_path / "seen"), batch_bytes=1)  # a file a micro-batch
    sizes = []
    for k, part in enumerate(parts):
        seen.add(part, str(k))
        if k == 1:
            exact.Seen(spark, str(tmp_path / "seen")).add(part, "1")
        sizes.append(seen.groups().agg(F.sum("n")).first()[0])
    assert sizes == [len(rows[0::3]), len(rows[0::3]) + len(rows[1::3]), len(rows)]
    want = {(s, n, i) for _, i, n, s in plain_groups(rows)}
    assert {(r.digest.hex(), r.n, r.first.id) for r in seen.groups().collect()} == want
    assert len({p.name for p in (tmp_path / "seen" / "groups").glob("batch=*")}) > 3
    got = exact.report(spark, parts)
    assert sorted([(r.id, r.keep_id, r.group_size, r.digest.hex()) for r in got.collect()], key=str) == plain_groups(rows)


def test_exact_rows_that_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a  b", 2), (None, "a b", 3), (None, "c", 4), (2, None, 5), (3, "", 6)], "doc_id long, text string, _row int").withColumn("file", F.lit("f"))
    left = exact.deduplicated(docs)
    assert left.columns == docs.columns
    ids = sorted([(r.doc_id, r.text) for r in left.collect()], key=str)
    assert [i for i, _ in ids] == [1, 2, None] and left.count() == 3
    assert exact.deduplicated(docs.limit(0)).count() == 0


# prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node in sorted(members, key=len, reverse=True):
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), sum(not kids[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng, convs, words=2, depth=8):
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, depth)):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 2 else "user", f"wörd {rng.randrange(words)} 😀"))
    rng.shuffle(rows)
    return rows


def spark_trie(spark, rows, partitions=5, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("sizes", F.lit(1)).withColumn("t", F.lit(1))
    return sorted(map(tuple, trie.prefix_trie(table.repartition(partitions), **more).collect()), key=str)


@pytest.mark.parametrize("range_bytes", [1 << 20, 700, 60])
def test_trie(spark, range_bytes):
    """From a few ranges to about one a conversation, so that nodes of every kind cross their ends."""
    rng = random.Random(range_bytes)
    rows = talk(rng, [*range(0, 120), 250, 301, -5, -100, -205])
    rows += [(7, None, None, None), (7, None, "user", "early"), (500, 0, None, ""), (None, 0, "user", "of none"), (None, None, None, None)]
    rows += [(600 + i, 3, "user", "one") for i in range(12)]  # some of them are left without a turn
    rows += [(800, 1, "user", "same"), (800, 1, "user", "same"), (800, 1, "bot", "same"), (800, 2, "user", "x" * 70_000)]
    assert spark_trie(spark, rows, range_bytes=range_bytes) == plain_trie(rows)


@pytest.mark.parametrize("range_bytes", [1 << 20, 400])
def test_trie_of_copies(spark, range_bytes):
    """One conversation many times, one that goes on where it ends, and deep ones that share all but the last turn."""
    rows = [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)] + [(140, t, "user", f"same {t}") for t in range(5)]
    rows += [(c, t, "user", f"deep {t}" if t < 39 else f"end {c}") for c in (200, 201, 202, 203) for t in range(40)]
    assert spark_trie(spark, rows, range_bytes=range_bytes) == plain_trie(rows)


def test_trie_of_none(spark):
    assert spark_trie(spark, []) == [] and spark_trie(spark, [(None, 1, "user", "x")]) == []
    lonely = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert spark_trie(spark, [(lonely, 0, "user", "x")]) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_merge_compares_behind_shared_turns(monkeypatch):
    """The loser tree gives the sorted rows with their common prefixes, and looks at far fewer turns than comparing whole rows would."""
    rng = random.Random(1)
    looked = [0]

    def counted(a, b, known=0):
        start, most = known, min(len(a), len(b)) // trie.DIGEST
        while known < most and a[known * 32 : known * 32 + 32] == b[known * 32 : known * 32 + 32]:
            known += 1
        looked[0] += known - start + 1
        return known

    stem = [bytes([i]) * 32 for i in range(60)]
    rows = [(b"".join([*stem[: rng.randrange(50, 61)], *[bytes([rng.randrange(3)]) * 32 for _ in range(3)]]), i, []) for i in range(400)]
    runs = []
    for k in range(7):
        run = sorted(rows[k::7])
        runs.append([(*r, trie.shared(run[i - 1][0], r[0]) if i else 0) for i, r in enumerate(run)])
    monkeypatch.setattr(trie, "shared", counted)
    got = list(trie.merged(runs + [[]]))
    assert [g[:3] for g in got] == sorted(rows)
    assert [g[3] for g in got[1:]] == [counted(a[0], b[0]) for a, b in zip(got, got[1:])] and got[0][3] == 0
    whole = sum(counted(a[0], b[0]) for a, b in zip(got, got[1:]))
    looked[0] = 0
    list(trie.merged(runs))
    assert looked[0] < whole / 3


def test_rebuilt(spark):
    keep = Scratch(spark, "test")
    rows = [(100, t, "user", f"a{t}") for t in range(9)] + [(c, t, "user", f"{c}-{t}") for c in range(101, 112) for t in range(9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    name = lambda text: hashlib.sha256(f"4:user{text}".encode()).digest()
    for r in trie.rebuilt(table, keep).collect():
        h = zlib.crc32(str(r.conv_id).encode()) % 6
        want = [f"a{t}" for t in range(h)] + [f"{'a' if r.conv_id == 100 else f'{r.conv_id}-'}{t}" for t in range(h, 9)]
        assert bytes(r.key) == b"".join(map(name, want)) and r.sizes == [len(w) for w in want]
