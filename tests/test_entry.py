"""Driver contract: entry runs, every query has an oracle or is declared non-SQL."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["node", "rank"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    from tallyrank.plans.registry import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
