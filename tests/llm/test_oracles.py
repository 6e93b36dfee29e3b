"""Registered queries of this part against their SQL."""

import pytest

from gridcheck.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda rs: sorted(tuple(str(x) for x in r) for r in rs)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want[columns].itertuples(index=False))
