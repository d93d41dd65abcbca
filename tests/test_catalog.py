"""Every query against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkstrata import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b and a


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
