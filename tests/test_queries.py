"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tabularium.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else f"{x:.9g}"
        return f"{x:.9g}" if isinstance(x, int) and not isinstance(x, bool) else x

    return [names[i] for i in order], sorted(str([cell(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(rel.columns, rel.fetchall())
