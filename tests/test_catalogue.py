"""Every query against its SQL, in another engine, on the smallest tables; skipped where the tables or the engine are missing."""

import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return repr(round(float(v), 9))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(tuple(shown(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    b = sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_entry_and_names(spark):
    q = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(q)
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_totalprice"]
