"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from attestra import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, str):
        return (2, v)
    f = float(v)
    return (1, float(f"{f:.10g}") if math.isfinite(f) else f)


def _same(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and (x == y or x[0] == 1 and math.isclose(x[1], y[1], rel_tol=1e-8, abs_tol=1e-12)) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
    assert _same(got, want)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
