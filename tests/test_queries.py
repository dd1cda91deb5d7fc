"""The registered core queries against their SQL on the smallest data."""

import os

import duckdb
import pytest

from evidentia.plans import queries as core
from evidentia.session import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    cell = lambda v: "∅" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(core.SQL[name])
    assert sorted(want.columns) == cols
    assert plain(df.select(*cols).collect()) == plain(want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() >= 0
