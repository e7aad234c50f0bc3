"""Every query with SQL gives the SQL's rows on the smallest scale."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from specforge import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(([plain(dict(zip(cols, r))[c]) for c in sorted(cols)] for r in cur.fetchall()), key=key)
    got = sorted(([plain(r[c]) for c in sorted(cols)] for r in df.collect()), key=key)
    near = lambda v: pytest.approx(v, rel=1e-9, abs=2e-6) if isinstance(v, float) else v
    assert got == [[near(v) for v in r] for r in want]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
