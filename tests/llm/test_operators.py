"""Operators against brute force on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanwise.llm import decontaminate, feistel, licences, lines, minhash, mixing, quality, queries, secrets, sharding, shards, substring

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id long, h string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def table(spark, texts, ids=None):
    """Documents with column names that operators also use inside."""
    rows = [(i, t, "en", f"s{i % 3}" if i is not None and i % 5 else None, 0, 1, "k", 2, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    """Random texts with copies, edited copies, shared passages, nulls and blanks."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = make(50)
    texts = []
    for i in range(n):
        w = make(rng.choice([0, 1, 3, 4, 5, 40, 90, 150]))
        if i % 6 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    for i in range(n // 3):
        w = WORD.findall(texts[rng.randrange(n)])
        for _ in range(i % 4):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w).upper() if i % 2 else " ".join(w))
    return [*texts, None, "", "  \n\t", texts[0], texts[0], "Ärger über é x " * 20]


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(want)
    assert sorted(got) == columns
    pd.testing.assert_frame_equal(*(x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want)), check_dtype=False)


EMPTY = {
    "minhash": minhash.near_duplicates, "substring": substring.remove_repeats, "secrets": secrets.scan, "licences": licences.scan, "quality": quality.quality,
    "sharding": sharding.shard, "lines": lines.line_report, "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, percent):
    texts = corpus(3)
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((group[a], group[b]))
                    group = [low if g == high else g for g in group]
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, texts), percent).collect()}
    assert got == {i: (len(s), g, i == g) for i, (s, g) in enumerate(zip(sets, group, strict=True))}
    kept = minhash.deduplicated(table(spark, texts), percent)
    assert kept.columns == table(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_minhash_null_ids(spark):
    got = minhash.near_duplicates(table(spark, ["a b c d e f"] * 3 + [None], [None, 4, 4, 9])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got if r.doc_id != 9) == [(False, 4, True), (False, 4, True), (True, None, True)]


def test_superminhash_is_unbiased():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) for n in (800, 100, 100))
    sets = [np.sort(np.concatenate((shared, x))) for x in (a, b)]
    table_ = minhash.superminhash(np.concatenate(sets), np.array([0, 900, 1800]))
    assert abs((table_[0] == table_[1]).mean() - 0.8) < 0.1
    tiny = minhash.superminhash(sets[0][:1], np.array([0, 1]))
    assert sorted((tiny[0] >> np.uint64(56)).tolist()) == list(range(minhash.SLOTS))  # one element fills every place once


@pytest.mark.parametrize("window", [35, 12, 5])
def test_substring(spark, window):
    texts = corpus(5)
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    want = {}
    for k, w in enumerate(split):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[k] = (len(w), len(gone), hashlib.sha256(text.encode()).hexdigest(), text)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring.remove_repeats(table(spark, texts), window, with_text=True).collect()}
    assert got == want


@pytest.mark.parametrize("period", substring.COVERS)
def test_covers(period):
    members = substring.COVERS[period]
    assert {(a - b) % period for a in members for b in members} == set(range(period))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(feistel.permute(np.arange(n), n, 7).tolist()) == list(range(n))


def test_sharding(spark):
    texts = corpus(7)
    rows = sharding.shard(table(spark, texts), 7).collect()
    assert Counter(r.law for r in rows) == {"rows": len(texts)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard(table(spark, texts).repartition(7), 7).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def _targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if rate * w[s] > most * sizes[s]}
        if not over:
            return out | {s: rate * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    texts = corpus(9)
    docs = table(spark, texts)
    rows = mixing.mix(docs).collect()
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in docs.collect()}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    goal = _targets(totals)
    taken = Counter()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], totals[source[r.doc_id]]) and r.taken <= 3 * r.size
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    mixed = mixing.mixed(docs)
    got = Counter()
    for r in mixed.collect():
        got[source[r.doc_id]] += len(words(r.text))
    assert mixed.columns == docs.columns and all(got[s] == taken[s] for s in goal)


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1000, "c": 3}, {"a": 0, None: 7}, {"x": 10}, {"a": 1, "b": 1, "c": 100, "d": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(_targets(sizes))


def test_quality(spark):
    texts = [*corpus(11), "the The the\n" * 40, "a | b | c | d " * 30, "of the and x y z\n\nof the and x y z\n" * 3 + " ".join(f"w{i} the of" for i in range(60))]
    got = quality.quality(table(spark, texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.sql(quality.ORACLE)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert quality.passing(table(spark, texts)).columns == table(spark, []).columns


def test_decontamination(spark):
    rng = random.Random(4)
    make = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    items = [make(k) for k in (30, 14, 13, 20, 9)]
    near = items[0].copy()
    near[3], near[9] = "x", "y"
    far = [w if i % 4 else "z" for i, w in enumerate(items[3])]
    texts = [" ".join(make(40) + items[0] + make(40)), " ".join(make(10) + near), " ".join(items[1]).upper() + "!", ", ".join(items[2]), " ".join(make(50) + far), " ".join(make(200)), None, "", " ".join(make(3) + items[4])]
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2), (8, 4)}
    clean = decontaminate.clean(table(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == {4, 5, 6, 7} and clean.columns == table(spark, []).columns


def _within(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def test_lines(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.choice([10, 29, 30, 31, 45, 60]))) for _ in range(20)]
    texts = []
    for _ in range(25):
        out = []
        for _ in range(rng.randrange(5)):
            s = rng.choice(base)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(s))
                s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abé ") + s[i:], s[:i] + "x" + s[i + 1 :]])
            out.append(s)
        texts.append("\n".join(out))
    texts += [None, "", "\n\n"]
    every = [(d, k, s) for d, t in enumerate(texts) if t is not None for k, s in enumerate(t.split("\n")) if len(s) >= 30]
    want = defaultdict(list)
    for n, (d, k, s) in enumerate(every):
        if any(abs(len(s) - len(o)) <= 2 and _within(s, o, 2) for _, _, o in every[:n]):
            want[d].append(k)
    got = {r.doc_id: r.removed for r in lines.line_report(table(spark, texts)).collect()}
    assert got == {d: ",".join(map(str, want[d])) for d in range(len(texts))}
    left = {r.doc_id: r.text for r in lines.drop_lines(table(spark, texts)).collect()}
    assert all(left[d] == (None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in want[d])) for d, t in enumerate(texts))


def test_short_lines(spark, tmp_path):
    texts = ["Wh the.\n\n--\nWh the.", "Le.\nWh the.\n--\n\n" + "-" * 30, None, "Le.\nWh thE.\n" + "-" * 30, "é\né\n7\n7"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.removed) for r in lines.query(spark, str(tmp_path)).collect()}
    assert got == {0: (1, "3"), 1: (1, "1"), 2: (0, ""), 3: (2, "0,2"), 4: (2, "1,3")}
    left = {r.doc_id: r.text for r in lines.drop_lines(table(spark, texts), short=True).collect()}
    assert left == {0: "Wh the.\n\n--", 1: "Le.\n--\n\n" + "-" * 30, 2: None, 3: "Wh thE.", 4: "é\n7"}


def test_secrets(spark):
    texts = [
        "x token = 'abcdef12' y", "PASSWORD: short", "secret=token:abcdefgh", "AKIA" + "A1" * 8, "id " + "0af3" * 6, None, "",
        'KEY_A = "Zx81kLmn02Qp"\nclient.password = KEY_A', 'db_pwd: "hunter2hunter2"', "we walked: the key was here", "api_key=" + "q" * 5,
    ]
    got = {r.doc_id: r for r in secrets.scan(table(spark, texts)).collect()}
    assert {i: (got[i].n_assign, got[i].n_access, got[i].n_hex) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)} == {0: (1, 0, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 1, 0), 4: (0, 0, 1), 5: (0, 0, 0), 6: (0, 0, 0), 8: (0, 0, 0), 9: (0, 0, 0), 10: (0, 0, 0)}
    assert got[0].spans.startswith("assign:2:19") and got[0].base_sha256 == hashlib.sha256(b"assign:2:19").hexdigest()
    assert got[5].spans == "" and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "literal:9:23" in got[8].spans and got[9].spans == ""
    assert secrets.joined(secrets.lexed_spans('K = "Zx81kLmn02Qp"\nmy_pwd = K', [])) == "constant:5:17"
    assert secrets.redact(table(spark, texts)).where("doc_id = 8").first().text == 'db_pwd: "[SECRET]"'


def test_long_secrets(spark):
    rng = random.Random(9)
    key = "".join(rng.choice("ABCDEFabcdef0123456789+/xyzXYZ") for _ in range(720))
    pem = f"-----BEGIN PRIVATE KEY-----\\n{key}\\n-----END PRIVATE KEY-----\\n"
    texts = [f'private_key = "{key}"', f"private_key={key}", f"private_key = '{key}'", f"private_key = `{key}`", f'{{"private_key": "{pem}"}}', r'db_pwd = "ab\"Zx81kLmn02Qp"', r"db_pwd = 'ab\'Zx81kLmn02Qp'", 'db_pwd = "Zx81kLmn02Qp\\']
    got = {r.doc_id: r.spans for r in secrets.scan(table(spark, texts)).collect()}
    assert got == {0: "literal:15:735", 1: "literal:12:732", 2: "literal:15:735", 3: "literal:15:735", 4: f"literal:17:{17 + len(pem)}", 5: "literal:10:26", 6: "literal:10:26", 7: ""}
    left = {r.doc_id: r.text for r in secrets.redact(table(spark, texts)).collect()}
    assert left[0] == 'private_key = "[SECRET]"' and left[1] == "private_key=[SECRET]" and left[5] == 'db_pwd = "[SECRET]"'
    assert secrets.lexed_spans('a_key = "' * 200_000, []) == [] == secrets.lexed_spans('key = "' + "\\a" * 500_000, [])


def test_secrets_beyond_base_spans(spark):
    texts = ['password = "hunter2!Pa$$w0rd-91xQ"', "my_pwd = 'x!" + "0af3" * 6 + "!Qz'", 'password = "hunter2hunter2"']
    got = {r.doc_id: (r.spans, r.n_lexed) for r in secrets.scan(table(spark, texts)).collect()}
    assert got == {0: ("assign:0:19,literal:12:33", 1), 1: ("literal:10:39,hex:12:36", 1), 2: ("assign:0:26", 0)}
    left = {r.doc_id: r.text for r in secrets.redact(table(spark, texts)).collect()}
    assert left == {0: '[SECRET]"', 1: "my_pwd = '[SECRET]'", 2: '[SECRET]"'}


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace('"', "'")
    texts = [changed, "Intro text.\nLicensed under the Apache Licence, Version 2.0\nmore", "Released under the MIT License, not.", None, "", mit[:200]]
    got = {(r.doc_id, r.license_id, r.unit) for r in licences.scan(table(spark, texts)).collect()}
    assert {(0, "MIT", "text"), (1, "Apache-2.0", "line")} <= got and {g[0] for g in got} == {0, 1}


@pytest.mark.parametrize("length", [16, 64])
def test_shards_round_trip(spark, tmp_path, length):
    texts = corpus(13)
    docs = table(spark, texts).repartition(3).cache()
    manifest = shards.write_shards(docs, f"file://{tmp_path}/out", "bytes", length, 8).orderBy("shard").collect()
    data = b"".join((tmp_path / "out" / f"shard-{r.shard:08d}.bin").read_bytes() for r in manifest)
    slots = np.frombuffer(data, dtype="<u2").reshape(-1, length)
    stream = slots[feistel.permute(np.arange(len(slots)), len(slots), 1)].ravel()[: sum(r.tokens for r in manifest)]
    parts, part = [], []
    for t in stream.tolist():
        if t == 256:
            parts.append(bytes(part).decode())
            part = []
        else:
            part.append(t)
    assert parts == [r.text or "" for r in docs.collect()]
    assert all(hashlib.sha256((tmp_path / "out" / f"shard-{r.shard:08d}.bin").read_bytes()).hexdigest() == r.sha256 for r in manifest)
