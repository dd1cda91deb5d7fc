"""The registered training-data queries on the smallest data, and against SQL where there is any."""

import os

import duckdb
import pytest

from evidentia.llm.queries import QUERIES, SQL
from evidentia.session import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_agrees(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(SQL[name])
        assert sorted(rows) == sorted(want.select(*df.columns).fetchall())
