"""Driver contract: entry runs, every oracle has a query, names are unique."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert "avg_congestion" in df.columns


def test_oracles_have_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 40
