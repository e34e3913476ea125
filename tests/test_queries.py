"""Each query of the engine against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiqua import queries as q
from lexiqua import queries_more, queries_reports, queries_sources  # noqa: F401


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = q.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in q.ORACLES:
        want = duck.sql(q.ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
