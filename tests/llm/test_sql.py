"""Training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from pagewise.llm import queries

SQL = queries.oracle_sql()


def plain(x):
    return "NULL" if x is None else repr(round(x, 5) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    cur = con.execute(SQL[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == names
    at = [heads.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
