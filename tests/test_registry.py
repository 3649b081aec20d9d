import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from planloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(v):
    return "" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(tuple(map(canon, r)) for r in got.collect())
    b = sorted(tuple(map(canon, r)) for r in want.select(*[f'"{c}"' for c in got.columns]).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
