"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sessionlode.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.Q[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(repr(plain(tuple(r))) for r in x)
    assert rows(df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())
