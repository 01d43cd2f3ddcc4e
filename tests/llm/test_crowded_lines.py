"""Operator 8 where many lines share segments: the same rows as brute force, however small a crowd is."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanwise.llm import lines


def _within(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def _family(rng, n, digits):
    """Lines of one template: a number apart, a common end, and edits at any place."""
    out = []
    for _ in range(n):
        s = f"Order {rng.randrange(10 ** rng.choice(digits)):07d} was sent to the customer on day {rng.randrange(40)}"
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("0é x") + s[i:], s[:i] + "y" + s[i + 1 :]])
        out.append(s)
    return out


@pytest.mark.parametrize("edits,crowd,digits", [(2, 2, (2, 4, 7)), (1, 3, (1, 2))])
def test_crowded_segments(spark, edits, crowd, digits):
    every = _family(random.Random(edits * 100 + crowd), 100, digits)
    docs = spark.createDataFrame([(d, "\n".join(every[d * 4 : d * 4 + 4])) for d in range(25)], "doc_id long, text string")
    want = {divmod(n, 4) for n, s in enumerate(every) if any(_within(s, o, edits) for o in every[:n])}
    got = {(r.doc, r.at) for r in lines.repeated_lines(docs, edits=edits, crowd=crowd).collect()}
    assert got == want and 5 < len(want) < 100


def test_any_cut_keeps_pairs_within_the_edits(spark):
    rng = random.Random(8)
    for n in (0, 1, 2, 5, 6, 7, 13, 40):
        base = "".join(rng.choice("abc") for _ in range(n))
        others = set()
        for _ in range(30):
            s = base
            for _ in range(2):
                i = rng.randrange(len(s) + 1)
                s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abc") + s[i:], s[:i] + "a" + s[i + 1 :]])
            others.add(s)
        texts = sorted(others | {base})
        rows = spark.createDataFrame([(0, k, k, 0, len(t), t) for k, t in enumerate(texts)], "g long, k long, f long, bits int, n int, t string")
        index, probe = lines._cut(rows, 2, False).alias("b"), lines._cut(rows, 2, True).alias("a")
        met = {(r.a, r.b) for r in probe.join(index, "key").selectExpr("a.k AS a", "b.k AS b").distinct().collect()}
        for a, b in itertools.product(range(len(texts)), repeat=2):
            if len(texts[a]) >= len(texts[b]) and _within(texts[a], texts[b], 2):
                assert (a, b) in met, (texts[a], texts[b])


def test_letter_counts_of_the_highest_bit(spark):
    """Eight of the last counted letter and none of the others set the top bit of the packed counts alone."""
    texts = ["s" * 8 + "u" * 25, "s" * 8 + "u" * 24 + "x", "e" * 15 + "u" * 18, "s" * 8 + "u" * 30 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc, r.at) for r in lines.repeated_lines(docs).collect()} == {(1, 0)}


def test_rows_that_share_an_id_or_have_none(spark):
    """Each row is judged by itself: a repeat in one row takes nothing from another, and equal rows lose their lines but for the first."""
    long = "a line that is long enough to be compared by edits"
    rows = [
        (7, f"{long}\nthe second one is long enough and unique, too"), (7, "only here is this one long enough line\nsecond line unique also here and long"),
        (8, f"{long}!\nanother long line that nothing else is like 1234"), (None, long), (None, "this long line is only in a row that has no id"), (9, None), (9, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("_number", F.lit(3)).withColumn("doc", F.lit("x"))
    left = [(r.doc_id, r.text) for r in lines.drop_lines(docs).collect()]
    assert lines.drop_lines(docs).columns == docs.columns
    want = [
        (7, "the second one is long enough and unique, too"), (7, rows[1][1]), (8, "another long line that nothing else is like 1234"), (None, long), rows[4], (9, None), (9, ""),
    ]
    assert sorted(left, key=str) == sorted(want, key=str)
    report = sorted([(r.doc_id, r.n_lines, r.n_removed, r.removed) for r in lines.line_report(docs).collect()], key=str)
    assert report == sorted([(7, 2, 1, "0"), (7, 2, 0, ""), (8, 2, 1, "0"), (None, 1, 0, ""), (None, 1, 0, ""), (9, 0, 0, ""), (9, 1, 0, "")], key=str)
    twice = spark.createDataFrame([rows[0], rows[0]], "doc_id long, text string").coalesce(1)
    assert sorted(r.n_removed for r in lines.line_report(twice).collect()) == [0, 2]
    assert sorted(r.text for r in lines.drop_lines(twice).collect()) == ["", rows[0][1]]
