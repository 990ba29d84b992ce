"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from pagewise import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = queries.queries()
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    return "NULL" if x is None else repr(round(x, 5) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    df = ALL[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(SQL[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == names
    at = [heads.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
