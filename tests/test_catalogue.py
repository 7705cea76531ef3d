"""Every query of the core with SQL gives the same rows in DuckDB at the smallest scale; every other one runs."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from compare import norm  # noqa: E402
from vectide.plans import catalogue, event_queries  # noqa: E402

QUERIES = {**event_queries.QUERIES, **catalogue.QUERIES}
SQL = {**event_queries.SQL, **catalogue.SQL}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
