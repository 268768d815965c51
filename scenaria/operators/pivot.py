"""Conditional-aggregation pivots of the long fact.

``max(when(metric == m, value))`` is one hash aggregate (partial + final)
in the physical plan; ``groupBy().pivot()`` plans a second aggregate, so the
operators use the conditional form. ``max`` hides duplicate facts, as the
SQL pivot does; ``assert_unique`` in ``operators.audit`` reports them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_locate(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Hash-partition by the entity keys once, so later groupings and windows on
    ``(keys, ...)`` need no further exchange.

    Operators pivot first: the pivot's partial aggregate combines rows map-side,
    and keeps a partitioning by the keys that the input has (the marts' do), in
    which case Spark drops this repartition. Without keys the input is left as is.
    """
    keys = list(keys)
    return df.repartition(*keys) if keys else df


def pivot_metrics(
    fact: DataFrame,
    metrics: Mapping[str, str],
    by: Iterable[str],
    metric_col: str = "metric",
    value_col: str = "value",
    prefilter: bool = False,
) -> DataFrame:
    """One row per ``by`` group, one column per metric (``{metric name: column alias}``).

    Without ``prefilter`` every group of ``by`` yields a row, even one that has
    none of the metrics (its columns are NULL), as an unfiltered SQL pivot does.
    ``prefilter=True`` pushes ``metric IN (...)`` to the scan and drops such rows.
    """
    if prefilter:
        fact = fact.where(F.col(metric_col).isin(list(metrics)))
    aggs = [F.max(F.when(F.col(metric_col) == m, F.col(value_col))).alias(a) for m, a in metrics.items()]
    return fact.groupBy(*list(by)).agg(*aggs)


def pivot_scenarios(
    df: DataFrame,
    scenarios: Mapping[str, str],
    by: Iterable[str],
    value_col: str = "value",
    scenario_col: str = "scenario",
) -> DataFrame:
    """One row per ``by`` group, one column per scenario (``{scenario: column alias}``)."""
    aggs = [F.max(F.when(F.col(scenario_col) == s, F.col(value_col))).alias(a) for s, a in scenarios.items()]
    return df.groupBy(*list(by)).agg(*aggs)
