"""Driver contract: entry() runs; every query with an oracle has a builder."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "io_burstiness_std" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 37


def test_every_oracle_query_runs(spark):
    """Smoke: every query with an oracle builds and runs on the smallest tables."""
    from tests.conftest import SF_SMALL
    q = E.queries()
    for name in E.oracle_sql():
        df = q[name](spark, SF_SMALL)
        assert df.count() >= 0, name
