"""Every registered query against its checking SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in CHECKS:
        assert got
        return
    cur = duck.execute(CHECKS[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())
