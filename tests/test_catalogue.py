"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import os

import pytest

import __spark_entry__ as entry
from timeweave import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return v.isoformat() if isinstance(v, dt.datetime) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
