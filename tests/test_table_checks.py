"""The registered table queries against their SQL, and small cases by hand."""

import math

import pandas as pd
import pytest

from gridcheck.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    missing = lambda v: v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v))
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if missing(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_without_sql_runs(spark):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, DATA).count() >= 0
