"""Every registered query of the library against its SQL in DuckDB."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from tabulon import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return repr(float(value) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    cursor = oracle.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
