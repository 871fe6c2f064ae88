"""The corpus queries that SQL can express, over the smallest tables."""

import os

import pytest

from tallysieve.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(tuple(map(plain, row)) for row in df.select(*names).collect())
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert ours == sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())
