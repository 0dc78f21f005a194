"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest

from tidemill.plans.registry import QUERIES, TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else 0.0 if v == 0 and isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query(spark, duck, name):
    df = QUERIES[name].run(spark, FOLDER)
    want = duck.execute(QUERIES[name].sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
