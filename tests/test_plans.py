"""Physical-plan shape: pushdown, pruning and exchange counts."""

import os

import pytest

from scenaria.operators import timeseries as ts
from scenaria.plans.catalog import QUERIES
from scenaria.sources import marts

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_flag_filter(spark):
    p = plan(marts.fact(spark, SF_DIR))
    assert "PushedFilters: [In(l_returnflag, [A,N,R])" in p
    lineitem_scan = [line for line in p.splitlines() if "lineitem.parquet" in line][0]
    assert "l_comment" not in lineitem_scan and "l_partkey" not in lineitem_scan


def test_operators_reuse_the_fact_partitioning(spark):
    fact = marts.fact(spark, SF_DIR)
    base = plan(fact).count("Exchange")
    for op in (ts.operating_leverage, ts.unit_economics, ts.margin_of_safety, ts.growth_overtake):
        p = plan(op(fact, keys=marts.PL_KEYS))
        # pivot + windows on (entity, ...) add no exchange over the mart's own
        assert p.count("Exchange") == base, op.__name__


def test_no_python_udfs_in_any_query(spark):
    for name, q in QUERIES.items():
        p = plan(q(spark, SF_DIR))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_no_static_broadcast_of_the_fact_table(spark):
    # Broadcast decisions are made by AQE from measured sizes at runtime.
    p = plan(marts.fact(spark, SF_DIR))
    assert "BroadcastExchange" not in p.split("isFinalPlan=false")[-1] or "isFinalPlan=true" in p


def scans(p: str) -> int:
    """Scans of lineitem in a plan, not counting subtrees that it reuses."""
    return sum("lineitem.parquet" in line for line in p.splitlines())


@pytest.mark.parametrize("name", ["cumulative_payback", "flow_trace", "load_audit", "lever_ranking", "grid_audit", "kpi_totals"])
def test_one_warehouse_pass_and_no_job_before_an_action(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"plan-{name}", name)
    df = QUERIES[name](spark, SF_DIR)
    assert not tracker.getJobIdsForGroup(f"plan-{name}")
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert scans(final) == 1, final


def test_grid_audit_exchanges(spark):
    df = QUERIES["grid_audit"](spark, SF_DIR)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert sum("Exchange " in line or "Exchange\n" in line for line in final.splitlines()) <= 9, final


def test_loaded_tables_are_combined_before_they_are_shuffled(spark, tmp_path):
    marts.fact(spark, SF_DIR).write.parquet(str(tmp_path / "fact"))
    loaded = spark.read.parquet(str(tmp_path / "fact"))
    p = plan(ts.operating_leverage(loaded, keys=marts.PL_KEYS)).splitlines()
    first = max(i for i, line in enumerate(p) if "Exchange" in line)
    assert any("HashAggregate" in line and "partial_max" in line for line in p[first:])
