import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_file
from curbside.plans.oracles import ORACLES
from curbside.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_file.queries()) and set(ORACLES) <= set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, duck, name):
    found = entry_file.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    expected = duck.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in expected.fetchall()]
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert rows
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["client_id", "taxi_id", "rk", "dist"] and df.count() == 600
