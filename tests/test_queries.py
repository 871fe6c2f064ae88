"""Registered queries against their SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallysieve.plans.oracle import SQL
from tallysieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(int(v)) if isinstance(v, float) and v == int(v) else repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(tuple(map(plain, row)) for row in df.select(*names).collect())
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert ours == sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
