"""Every query with SQL gives the same rows in DuckDB."""

import datetime

import pytest

from floeworks.plans.all import ORACLES, QUERIES

TABLES = ("orders", "lineitem", "events", "documents", "embeddings", "labels")


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"{int(v)}b"
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    names = found.columns
    assert sorted(names) == columns
    want = [tuple(x[names.index(c)] for c in columns) for x in found.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)
