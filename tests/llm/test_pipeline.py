"""The pipeline's stages, each against its own input: brute force by DuckDB for those that take rows out, counts for the rest."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as cp
from spanwise.llm import decontaminate, minhash, mixing, quality

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sql(docs, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    con.register("documents", docs.toPandas())
    return con.sql(query).df()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)

    def ids(df):
        assert df.columns == columns
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    judged = sql(docs, quality.ORACLE)
    passing = stages["quality rules"](spark, docs, DATA).cache()
    assert ids(passing) == sorted(judged[judged.kept].doc_id) and passing.count() > 0
    groups = sql(passing, minhash.ORACLE.replace("85 *", "80 *"))
    single = stages["MinHash near-dedup"](spark, passing, DATA).cache()
    assert ids(single) == sorted(groups[groups.kept].doc_id)
    found = sql(single, decontaminate.ORACLE)
    clean = stages["benchmark decontamination"](spark, single, DATA).cache()
    assert ids(clean) == sorted(set(ids(single)) - set(found.doc_id))
    mixed = stages["mixing sources to target weights"](spark, clean, DATA).cache()
    assert mixed.columns == columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken}
    out = stages["sharding"](spark, mixed, DATA).collect()
    assert len(out) == mixed.count() and Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1


def corpus(n=60):
    """Good documents with a copy, a benchmark passage, null ids and texts, repeated rows, and a clashing column."""
    base = " ".join(f"word{i} the of" for i in range(30))
    rows = [(i, f"{base} number{i} " + " ".join(f"own{i}x{j} it to" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(n)]
    return [*rows, rows[0], (None, rows[1][1], "en", None, 1), (99, rows[2][1], None, "s0", 1), (98, None, "en", "s1", 1), (97, "", "en", "s1", 1)]


def test_rows_of_every_kind(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _row", "2 AS n", "'x' AS _gone")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "own5x1 it to own5x2 it to own5x3 it to own5x4 it to"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(60)) - {5} and len({r.doc_id for r in out}) > 30


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_nothing_left(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_runs_in_threads_leave_each_other_alone(spark):
    """A sweep takes the tables of its own thread only."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from spanwise.llm.scratch import Scratch, mark, sweep

    both = Barrier(2)

    def run(k):
        outer = Scratch(spark, f"outer-{k}")
        kept = outer.save(spark.range(10 + k), "kept")
        since = mark()
        gone = Scratch(spark, f"inner-{k}").save(spark.range(5), "gone")
        both.wait(60)  # each has made its tables before any is swept
        if k == 0:
            sweep(spark, since)
        both.wait(60)
        left = kept.count(), (gone.count() if k else None)
        if k:
            sweep(spark, since)
        return left

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, range(2))) == [(10, None), (11, 5)]
