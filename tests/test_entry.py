"""Driver contract smoke test."""

import __spark_entry__ as entry
from scenaria.plans.catalog import QUERIES


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"entity", "fiscal_year", "month", "metric", "spread_high_low"} <= set(df.columns)
    q = entry.queries()
    o = entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 20
    assert set(QUERIES) <= set(o)  # every analysis has its SQL
