"""Every query with a DuckDB equivalent gives its rows at the smallest scale."""

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not re.match(r"op\d", n)]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    columns = sorted(got)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
