"""Every query against its SQL in a second engine, on the small tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from thicketry.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    tidy = lambda x: round(x, 8) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(tuple(str(tidy(r[i])) for i in order) for r in data)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(got, df.columns) == rows(r.fetchall(), cols)
