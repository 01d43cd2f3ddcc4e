"""Licences inside files, stop-word shares, crowds of equal rows, and whole rows in shards."""

from collections import Counter

import duckdb
import pytest

from spanwise.llm import licences, mixing, quality, ranks, sharding

SCHEMA = "doc_id long, text string, source string"
MIT = licences.KNOWN[0][1]
BARE = licences.KNOWN[1][1]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sql(texts, query):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    return con.sql(query)


def wrapped(text, mark, width=60):
    out, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            out, line = [*out, line.strip()], ""
        line += f"{word} "
    return "\n".join(f"{mark} {x}" for x in [*out, line.strip()])


def test_licences_inside_files(spark):
    gpl = next(t for i, t in licences.KNOWN if i == "GPL-3.0-or-later")
    texts = [
        f"Copyright Foo Inc\n\n{BARE}",
        f"Copyright: The Foo Authors\n{BARE}",
        "#!/bin/sh\n" + wrapped(BARE, "#") + "\n#\n\nset -e\necho done\n",
        "/*\n" + wrapped("MIT License", " *") + "\n *\n * Copyright (C) 2001  A. Nother\n *\n" + wrapped(BARE, " *", 40) + "\n */\nint main;",
        "// header\n" + wrapped(gpl, "//", 30) + "\n\nbody of the file\n" + wrapped(gpl, "//", 50),
        wrapped(BARE, "#").replace("WITHOUT WARRANTY", "WITH WARRANTY") + "\nx",
        wrapped(BARE, "#") + " and more",
        "first\n" + wrapped(BARE, "#") + " and more",
        BARE,
        "copyright notice and this permission notice shall be\nkept\ncopyright  holders say no\nCopyright  holder\r\nx",
        None,
        "",
        "\n \n",
        "this\n" * 3000 + wrapped(gpl, "", 1),
    ]
    found = [tuple(r) for r in licences.scan(table(spark, texts)).select("doc_id", "license_id", "unit", "n_found").collect()]
    got = {(d, i, u): n for d, i, u, n in found}
    assert Counter(found) == Counter(sql(texts, licences.ORACLE).fetchall())
    assert got[0, "MIT", "text"] == got[1, "MIT", "text"] == got[2, "MIT", "run"] == got[8, "MIT", "text"] == 1
    assert got[3, "MIT", "run"] == 2  # with the heading and without
    assert got[4, "GPL-3.0-or-later", "run"] == 2 and got[13, "GPL-3.0-or-later", "run"] == 1
    assert {d for d, *_ in found} == {0, 1, 2, 3, 4, 8, 13}


def test_known_table_of_the_caller(spark):
    known = spark.createDataFrame([("A", "alpha beta gamma\ndelta epsilon"), ("B", "Alpha, beta gamma delta epsilon!"), ("C", "alpha beta"), (None, "x"), ("D", None), ("E", "...")], "license_id string, text string")
    texts = ["alpha\nbeta gamma\ndelta epsilon", "x\nalpha\nbeta gamma delta epsilon\ny", "alpha beta\ngamma", "..."]
    got = sorted(map(tuple, licences.scan(table(spark, texts), known).collect()))
    assert got == [(0, "A", "text", 1), (0, "B", "text", 1), (1, "A", "run", 1), (1, "B", "run", 1), (2, "C", "line", 1)]
    assert licences.scan(table(spark, texts), known.limit(0)).count() == 0


def test_stop_word_share(spark):
    filler = " ".join(f"qu{chr(97 + i % 26)}x" for i in range(60))
    texts = [
        "the, Of. And! " * 20 + filler,  # case and punctuation hide nothing
        filler + " the",  # one in 61 runs
        "这是 一个 测试 文本 " * 20,  # no list for this script
        "这是 一个 测试 Python " * 20,
        "zdanie bez słów z listy " * 12 + " ".join(f"z{i}" for i in range(20)),
        None,
    ]
    rows = {r.doc_id: r for r in quality.quality(table(spark, texts)).collect()}
    assert (rows[0].n_stop_words, rows[0].n_terms) == (60, 120) and "stop_words" not in rows[0].failed_rules
    assert (rows[1].n_stop_words, rows[1].n_terms) == (1, 61) and "stop_words" in rows[1].failed_rules
    assert [rows[i].n_terms for i in (2, 3, 5)] == [0, 0, 0] and all("stop_words" not in rows[i].failed_rules for i in (2, 3))
    assert "stop_words" in rows[4].failed_rules
    want = sql(texts, quality.ORACLE)
    assert sorted(map(tuple, quality.quality(table(spark, texts)).select(*want.columns).collect())) == sorted(want.fetchall())
    named = table(spark, texts).selectExpr("*", "if(doc_id = 4, 'pl', if(doc_id = 1, 'en', null)) AS lang")
    judged = {r.doc_id: r.failed_rules for r in quality.quality(named, lang_col="lang").collect()}
    assert "stop_words" not in judged[4] and "stop_words" in judged[1]
    assert quality.passing(named, lang_col="lang").columns == named.columns


@pytest.fixture
def small_lots(monkeypatch):
    whole = ranks.dealt.__defaults__
    monkeypatch.setattr(ranks.dealt, "__defaults__", (5,))
    yield
    assert whole == (ranks.LOT,)


def crowd():
    rows = [(None, None, None)] * 203 + [(7, "one two three", "a")] * 104 + [(i, f"text {i}", "a") for i in range(100)]
    return rows + [(200, "same words here", "b")] * 5 + [(201, "six of them", "b")] * 6


def test_lots_of_equal_rows(spark, tmp_path):
    from spanwise.llm.scratch import Scratch

    docs = spark.createDataFrame(crowd(), SCHEMA).repartition(7)
    got = ranks.dealt(docs, ["doc_id", "text", "source"], Scratch(spark, "test"), 5).collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter(crowd())
    for row, n in Counter(crowd()).items():
        assert Counter(r._deal for r in got if tuple(r)[:3] == row) == Counter(i // 5 for i in range(n))


def test_shards_and_mix_of_crowds(spark, small_lots):
    rows = crowd()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = sharding.shard(docs).collect()
    assert sorted(r.row for r in out) == sorted(r.position for r in out) == list(range(len(rows)))
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    again = sharding.shard(docs.repartition(3)).collect()
    order = lambda x: sorted(map(str, x))
    assert order(again) == order(out)  # equal rows share the same slots, however the input is cut
    mix = mixing.mix(docs).collect()
    taken = Counter()
    for r in mix:
        taken[r.source] += r.taken
    goals = {r.source: r.target for r in mix}
    assert len(mix) == len(rows) and all(taken[s] == int(goals[s] + 1e-6) for s in goals)
    assert order(mixing.mix(docs.repartition(2)).collect()) == order(mix)
    words = Counter()
    for r in mixing.mixed(docs).collect():
        words[r.source] += len(r.text.split())
    assert words == +taken


def test_rows_travel_with_their_shards(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "c" * 100_000, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS slot", "'z' AS document", "3 AS _number", "4 AS _p")
    out = sharding.sharded(docs).collect()
    slim = sharding.shard(docs)
    assert sorted(map(str, (tuple(r[c] for c in slim.columns) for r in out))) == sorted(map(str, (tuple(r) for r in slim.collect())))
    assert Counter(tuple(r.document) for r in out) == Counter(tuple(r) for r in docs.collect())
    assert all(r.doc_id == r.document.doc_id for r in out)
    assert sharding.sharded(docs.limit(0)).count() == 0
