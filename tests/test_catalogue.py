"""Every named query against its SQL twin over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gridloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-6)
