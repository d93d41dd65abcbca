"""Queries that read whole tables against their SQL twins, on larger tables than those of test_catalog."""

import os

import duckdb
import pytest

from sparkstrata import catalog

FOLDER = "/root/testdata/sf0.01"
TABLES = "part orders lineitem events embeddings".split()
NAMES = ["call_status", "flatten_nested", "index_members", "interval_overlap", "link_resolution", "package_versions", "tree_depth"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_reads_whole_tables(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, FOLDER).select(*want.columns).collect()
    a = sorted((tuple(plain(v) for v in r) for r in got), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    assert a == b and a
