"""Portfolio, trace and audit operators."""

import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria import schema as S
from scenaria.operators import audit as au
from scenaria.operators import portfolio as pf

WEIGHTS = {"Low": 0.25, "Base": 0.50, "High": 0.25}

# The six traced drivers of the planning model and their labels.
DRIVERS = (
    ("Utilization Rate", "Utilization Rate", 1),
    ("Total Fleet Size", "Fleet Size", 2),
    ("Operating Hours per Day", "Operating Hours/Day", 3),
    ("Average Ride Duration", "Avg Ride Duration (min)", 4),
    ("Price per Minute", "Price per Minute", 5),
    ("Average Discount Rate", "Discount Rate", 6),
)


def test_weighted_expectation_golden(fact):
    rs = rows(pf.weighted_expectation(fact, WEIGHTS), "month")
    assert len(rs) == 12
    assert rs[0]["exp_vs_base_pct"] == pytest.approx(44.6, abs=0.06)
    assert rs[-1]["exp_vs_base_pct"] == pytest.approx(85.0, abs=0.06)
    assert rs[-1]["cumulative_expected_ebitda"] == pytest.approx(50.36e6, rel=1e-3)


def test_weighted_expectation_all_weight_on_base_is_base(fact):
    rs = rows(pf.weighted_expectation(fact, {"Base": 1.0}), "month")
    for r in rs:
        assert r["expected_ebitda"] == r["base_ebitda"]
        assert r["exp_vs_base_delta"] == 0


def test_weighted_expectation_weights_frame(spark, fact):
    w = spark.createDataFrame(list(WEIGHTS.items()), "scenario string, weight double")
    assert rows(pf.weighted_expectation(fact, w), "month") == rows(pf.weighted_expectation(fact, WEIGHTS), "month")


def test_flow_trace_golden(spark, fact, totals):
    vals = {"Total Fleet Size": ("500", "350", "700"), "Utilization Rate": ("0.65", "0.55", "12abc")}
    data = [
        ("Fleet & Utilization", name, "unit", *vals.get(name, ("1", "0.5", "2")), "1") for name, _, _ in DRIVERS
    ] + [("Pricing", "Unused Driver", "x", "1", "1", "1", "1")]
    a = spark.createDataFrame(data, S.ASSUMPTIONS)
    rs = rows(pf.flow_trace(a, fact, totals, DRIVERS), "step_order", "metric")
    assert len(rs) == 25
    fleet = [r for r in rs if r["metric"] == "Fleet Size"][0]
    assert (fleet["low"], fleet["base"], fleet["high"], fleet["high_to_low_ratio"]) == (350, 500, 700, 2.0)
    util = [r for r in rs if r["metric"] == "Utilization Rate"][0]
    assert util["high"] is None and util["high_to_low_ratio"] is None  # '12abc' does not parse

    def ratio(step, metric):
        return [r for r in rs if r["step_order"] == step and r["metric"] == metric][0]["high_to_low_ratio"]

    assert ratio(10, S.RIDES) == pytest.approx(2.78)
    assert ratio(10, S.REVENUE) == pytest.approx(10.5, abs=0.06)
    assert ratio(10, S.CONTRIBUTION_MARGIN) == pytest.approx(26.4, abs=0.06)
    assert ratio(10, S.EBITDA) == pytest.approx(81.1, abs=0.06)
    assert ratio(20, S.REVENUE) == pytest.approx(19.6, abs=0.06)
    assert ratio(20, S.EBITDA) == pytest.approx(-91.5, abs=0.06)
    units = {r["metric"]: r["unit"] for r in rs if r["step_order"] == 30}
    assert units[S.EBITDA_PCT] == "%" and units[S.RIDES] == "rides" and units[S.CONTRIBUTION_MARGIN] == "€"
    big = [r for r in rs if r["step_order"] == 10 and r["metric"] == S.REVENUE][0]
    assert big["base"] == round(big["base"])  # above 10,000: 0 digits


def test_reconcile_pass_fail_incomplete(spark, fact):
    rs = rows(au.reconcile(fact))
    assert len(rs) == 36 and all(r["integrity_status"] == "PASS" for r in rs)
    bumped = fact.withColumn(
        "value",
        F.when((F.col("metric") == S.EBITDA) & (F.col("month_number") == 3) & (F.col("scenario") == "Low"),
               F.col("value") + 0.02).otherwise(F.col("value")),
    )
    bad = [r for r in rows(au.reconcile(bumped)) if r["integrity_status"] == "FAIL"]
    assert [(r["scenario"], r["month"]) for r in bad] == [("Low", 3)]
    missing = fact.where(~((F.col("metric") == S.PLATFORM_OVERHEAD) & (F.col("month_number") == 2)))
    lax = rows(au.reconcile(missing))
    assert all(r["integrity_status"] == "PASS" for r in lax)
    strict = [r for r in rows(au.reconcile(missing, strict=True)) if r["integrity_status"] == "INCOMPLETE"]
    assert len(strict) == 3 and all(r["month"] == 2 for r in strict)


def test_grid_audit_pass_and_faults(spark, price_util, growth):
    grids = [au.AuditGrid("sensitivity_price_util", price_util, 0.29, 0.65),
             au.AuditGrid("sensitivity_growth", growth, 0.03, 0.01)]
    rs = rows(au.grid_audit(grids), "audit_check", "table_name")
    assert len(rs) == 6
    assert all(r["status"] == "PASS" for r in rs)
    comp = [r for r in rs if r["audit_check"] == "1_GRID_COMPLETENESS"]
    assert {r["grid_shape"] for r in comp} == {"5 x 5 x 2"}
    assert all(r["total_rows"] == 50 and r["expected_rows"] == 50 for r in comp)

    dup = price_util.unionByName(price_util.limit(1))
    bad = rows(au.grid_audit([au.AuditGrid("pu", dup, 0.29, 0.65), grids[1]]), "audit_check")
    st = {(r["audit_check"], r["table_name"]): r["status"] for r in bad}
    assert st[("1_GRID_COMPLETENESS", "pu")] == "FAIL" and st[("2_DUPLICATE_CHECK", "pu")] == "FAIL"

    empty = price_util.where("false")
    e = rows(au.grid_audit([au.AuditGrid("empty", empty), grids[1]], cross_check=None), "audit_check")
    ce = [r for r in e if r["table_name"] == "empty" and r["audit_check"] == "1_GRID_COMPLETENESS"][0]
    assert ce["total_rows"] == 0 and ce["status"] == "FAIL"  # NULL null-count fails

    no_base = price_util.where(~((F.col("x") == 0.29) & (F.col("y") == 0.65)))
    g2 = [au.AuditGrid("pu", no_base, 0.29, 0.65), grids[1]]
    assert not [r for r in rows(au.grid_audit(g2)) if r["audit_check"] == "3_BASE_CASE_CROSS_CHECK"]
    strict = [r for r in rows(au.grid_audit(g2, strict=True)) if r["audit_check"] == "3_BASE_CASE_CROSS_CHECK"]
    assert len(strict) == 2 and all(r["status"] == "FAIL" for r in strict)


def test_load_audit_and_unique(spark, fact, totals):
    rs = rows(au.load_audit({"pl_monthly": fact, "pl_fy_totals": totals}), "table_name")
    assert [(r["table_name"], r["n_rows"]) for r in rs] == [("pl_fy_totals", 33), ("pl_monthly", 396)]
    assert au.assert_unique(fact, ["scenario", "month_number", "metric"]).count() == 0
    assert au.assert_unique(fact.unionByName(fact.limit(2)), ["scenario", "month_number", "metric"]).count() == 2


def test_report_marts(spark, fact, totals, price_util):
    k = rows(pf.kpi_totals(totals), "scenario")
    assert [r["scenario"] for r in k] == ["Base", "High", "Low"]
    assert k[0]["fy_ebitda"] == pytest.approx(30.52e6, rel=1e-3)
    c = rows(pf.cost_structure(totals))
    for r in c:
        assert r["variable_pct"] + r["vehicle_fixed_pct"] + r["platform_pct"] == pytest.approx(100, abs=0.02)
    m = rows(pf.sensitivity_matrix(price_util, S.OUT_MARGIN, ["0.5", "0.575", "0.65", "0.725", "0.8"]), "x")
    assert len(m) == 5 and m[2]["y_0p65"] == pytest.approx(0.6421, abs=1e-4)
    t = rows(pf.margin_trajectory(fact))
    assert len(t) == 36


def test_grid_vs_totals_check(spark, price_util, totals):
    import fixtures as fx

    rs = rows(au.grid_vs_totals_check(price_util, totals, 0.29, 0.65), "output")
    # The grid runs without cost inflation; the P&L has it: revenue agrees, margin does not.
    st = {r["output"]: r["status"] for r in rs}
    assert st == {S.OUT_MARGIN: "FAIL", S.OUT_REVENUE: "PASS"}
    flat = {k: dict(v, gi=0.0, v0=1.97, vf=600.0, po=24800) for k, v in fx.PARAMS.items()}
    t0 = spark.createDataFrame(fx.totals_pdf(params=flat))
    assert {r["status"] for r in au.grid_vs_totals_check(price_util, t0, 0.29, 0.65).collect()} == {"PASS"}


def test_present_orders_rows(spark):
    from scenaria.plans.catalog import ORDER, QUERIES, present

    assert set(ORDER) <= set(QUERIES)
    df = spark.createDataFrame([("B", 2), ("A", 1)], "table_name string, n_rows long")
    assert [r["table_name"] for r in present(df, "load_audit").collect()] == ["A", "B"]


def test_hazards_zero_base_missing_weight_and_hidden_missing_cell(spark, fact, price_util):
    from scenaria.operators import timeseries as ts

    # zero Base: spread as % of Base is NULL, not an error
    zero_base = fact.withColumn(
        "value", F.when((F.col("scenario") == "Base") & (F.col("metric") == S.EBITDA), F.lit(0.0)).otherwise(F.col("value"))
    )
    r = [x for x in rows(ts.scenario_spread(zero_base)) if x["metric"] == S.EBITDA]
    assert all(x["spread_as_pct_of_base"] is None for x in r) and all(x["spread_high_low"] is not None for x in r)
    # a scenario without a weight drops out; weights are not renormalised
    only = rows(pf.weighted_expectation(fact, {"Base": 0.5}), "month")
    assert all(abs(x["expected_ebitda"] - x["base_ebitda"] * 0.5) <= 0.0051 for x in only)
    assert all(x["ebitda_range_high_low"] is None for x in only)  # High / Low rows are gone
    # a missing cell plus a duplicate keeps rows == product: completeness passes, duplicates catch it
    cell = (F.col("x") == 0.29) & (F.col("y") == 0.65) & (F.col("output") == S.OUT_MARGIN)
    other = (F.col("x") == 0.21) & (F.col("y") == 0.5) & (F.col("output") == S.OUT_MARGIN)
    broken = price_util.where(~cell).unionByName(price_util.where(other))
    rs = {r["audit_check"]: r for r in rows(au.grid_audit([au.AuditGrid("pu", broken)], cross_check=None))}
    assert rs["1_GRID_COMPLETENESS"]["status"] == "PASS" and rs["1_GRID_COMPLETENESS"]["total_rows"] == 50
    assert rs["2_DUPLICATE_CHECK"]["status"] == "FAIL" and rs["2_DUPLICATE_CHECK"]["total_rows"] == 1
