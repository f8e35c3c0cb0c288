"""Every registered query against its SQL twin on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from registry.tables import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(frame.columns)
    names = sorted(columns)
    got = canonical([tuple(r) for r in frame.collect()], [frame.columns.index(c) for c in names])
    assert got == canonical(want.fetchall(), [columns.index(c) for c in names])
