"""Driver contract and the differential oracle check on the smallest tables."""

import pytest

from tests.oracle_compare import compare, duck

SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert set(df.columns) == {"run_below1", "n_rows", "n_default_6m", "default_rate_6m"}
    assert df.count() >= 1


def test_registry_contract():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


def _oracle_names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _oracle_names())
def test_oracle(spark, name):
    ok, msg = compare(spark, duck(SMALL), name, SMALL)
    assert ok, msg
