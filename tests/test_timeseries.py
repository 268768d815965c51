"""Time-series operators against the closed-form model's golden values and identities."""

import math

import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria import schema as S
from scenaria.operators import timeseries as ts


def pick(rs, **kw):
    out = [r for r in rs if all(r[k] == v for k, v in kw.items())]
    assert len(out) == 1, (kw, out)
    return out[0]


def test_scenario_spread_golden(fact):
    rs = rows(ts.scenario_spread(fact))
    assert len(rs) == 36
    m1, m12 = pick(rs, metric=S.EBITDA, month=1), pick(rs, metric=S.EBITDA, month=12)
    assert m1["spread_high_low"] == pytest.approx(7.70e6, rel=2e-3)
    assert m12["spread_high_low"] == pytest.approx(16.87e6, rel=2e-3)
    assert round(m1["spread_as_pct_of_base"]) == 369
    assert round(m12["spread_as_pct_of_base"]) == 552
    assert m1["spread_mom_growth"] is None
    growth = [pick(rs, metric=S.EBITDA, month=m)["spread_mom_growth"] for m in range(2, 13)]
    assert all(7.0 < g < 8.0 for g in growth)


def test_scenario_spread_cumulative_is_sum_of_spreads(fact):
    rs = rows(ts.scenario_spread(fact), "metric", "month")
    for metric in (S.REVENUE, S.CONTRIBUTION_MARGIN, S.EBITDA):
        series = [r for r in rs if r["metric"] == metric]
        total = sum(r["spread_high_low"] for r in series)
        assert series[-1]["cumulative_spread"] == pytest.approx(total, abs=0.01 * 12)


def test_zero_crossings_golden(fact):
    rs = rows(ts.zero_crossings(fact), "metric")
    assert len(rs) == 2
    assert {r["metric"] for r in rs} == {S.EBITDA, S.EBITDA_PCT}
    for r in rs:
        assert r["scenario"] == "Low"
        assert r["crossing_direction"] == "Positive to Negative"
        assert r["crossing_month"] == 6
        assert r["interpolated_zero_month"] == pytest.approx(5.42)
        assert r["total_months_positive"] == 5
    e = pick(rs, metric=S.EBITDA)
    assert e["value_before_crossing"] > 0 > e["value_after_crossing"]
    assert e["absolute_swing"] == pytest.approx(e["value_before_crossing"] - e["value_after_crossing"], abs=0.011)


def test_zero_is_non_negative(spark):
    # >=0 -> <0 crosses; <0 -> 0 crosses; >0 -> 0 does not.
    data = [("S", m, "EBITDA", v) for m, v in [(1, 5.0), (2, 0.0), (3, -1.0), (4, 0.0), (5, 2.0)]]
    f = spark.createDataFrame(data, "scenario string, month_number int, metric string, value double")
    rs = rows(ts.zero_crossings(f, metrics=["EBITDA"]), "crossing_month")
    assert [(r["crossing_month"], r["crossing_direction"]) for r in rs] == [
        (3, "Positive to Negative"),
        (4, "Negative to Positive"),
    ]
    assert rs[0]["interpolated_zero_month"] == pytest.approx(2.0)  # prev is exactly 0
    assert rs[0]["total_months_positive"] == 4


def test_operating_leverage_golden(fact):
    rs = rows(ts.operating_leverage(fact))
    assert len(rs) == 36
    assert pick(rs, scenario="Low", month=1)["dol"] == pytest.approx(3.18, abs=0.011)
    assert pick(rs, scenario="Low", month=5)["dol"] == pytest.approx(24.73, abs=0.05)
    assert pick(rs, scenario="Low", month=12)["dol"] < 0
    assert pick(rs, scenario="Base", month=1)["dol"] == pytest.approx(1.12, abs=0.011)
    assert pick(rs, scenario="Base", month=12)["dol"] == pytest.approx(1.13, abs=0.011)
    assert pick(rs, scenario="Base", month=1)["fixed_cost_pct_of_total"] == pytest.approx(19.6, abs=0.1)
    assert pick(rs, scenario="High", month=1)["fixed_cost_pct_of_total"] == pytest.approx(13.4, abs=0.1)
    assert pick(rs, scenario="Low", month=1)["fixed_cost_pct_of_total"] == pytest.approx(24.9, abs=0.1)
    r = pick(rs, scenario="Base", month=6)
    # The multiplier divides the rounded growth rates.
    assert r["leverage_multiplier"] == round(r["ebitda_mom_pct"] / r["rev_mom_pct"], 2)
    assert pick(rs, scenario="Base", month=1)["rev_mom_pct"] is None


def test_volume_price_mix_golden_and_identity(fact):
    rs = rows(ts.volume_price_mix(fact))
    assert len(rs) == 33
    b = pick(rs, scenario="Base", month=2)
    assert b["volume_pct"] == pytest.approx(77.0, abs=0.1)
    assert b["price_pct"] == pytest.approx(22.3, abs=0.1)
    h = pick(rs, scenario="High", month=2)
    assert (h["volume_pct"], h["price_pct"]) == pytest.approx((72.8, 25.9), abs=0.1)
    lo = pick(rs, scenario="Low", month=2)
    assert (lo["volume_pct"], lo["price_pct"], lo["mix_pct"]) == pytest.approx((100.0, 0.0, 0.0), abs=0.01)
    for r in rs:
        parts = r["volume_effect"] + r["price_effect"] + r["mix_effect"]
        assert parts == pytest.approx(r["total_rev_change"], abs=0.03)


def test_cumulative_payback_golden(fact, totals):
    rs = rows(ts.cumulative_payback(fact, totals))
    assert len(rs) == 36
    paid = {r["scenario"]: r["interpolated_payback"] for r in rs if r["payback_flag"] == "PAYBACK"}
    assert paid["Base"] == pytest.approx(1.79, abs=0.011)
    assert paid["High"] == pytest.approx(0.57, abs=0.011)
    assert "Low" not in paid
    assert pick(rs, scenario="Low", month=5)["cumulative_ebitda"] == pytest.approx(270501, abs=1)
    assert pick(rs, scenario="Low", month=12)["cumulative_ebitda"] == pytest.approx(-395338, abs=1)
    assert pick(rs, scenario="Base", month=12)["cumulative_ebitda"] == pytest.approx(30.52e6, rel=1e-3)
    assert pick(rs, scenario="High", month=12)["cumulative_ebitda"] == pytest.approx(140.81e6, rel=1e-3)


def test_cumulative_payback_recrossing(spark):
    f = spark.createDataFrame(
        [("S", m, "EBITDA", v) for m, v in [(1, 6.0), (2, -3.0), (3, 5.0), (4, 1.0)]],
        "scenario string, month_number int, metric string, value double",
    )
    t = spark.createDataFrame([("S", "Total Fixed Costs", 5.0)], "scenario string, metric string, fy_total double")
    every = rows(ts.cumulative_payback(f, t), "month")
    assert [r["payback_flag"] for r in every] == ["PAYBACK", None, "PAYBACK", None]
    assert every[0]["interpolated_payback"] == pytest.approx(5 / 6, abs=0.01)
    first = rows(ts.cumulative_payback(f, t, first_only=True), "month")
    assert [r["payback_flag"] for r in first] == ["PAYBACK", None, None, None]
    # scenarios without a target drop out
    t2 = spark.createDataFrame([("X", "Total Fixed Costs", 5.0)], "scenario string, metric string, fy_total double")
    assert ts.cumulative_payback(f, t2).count() == 0


def test_growth_overtake_golden(fact):
    rs = rows(ts.growth_overtake(fact))
    assert len(rs) == 33 and min(r["month"] for r in rs) == 2
    for sc, rev, cost in (("Base", 3.90, 4.49), ("High", 6.87, 5.78), ("Low", 1.00, 3.49)):
        r = pick(rs, scenario=sc, month=2)
        assert r["revenue_mom_pct"] == pytest.approx(rev, abs=0.006)
        assert r["total_cost_mom_pct"] == pytest.approx(cost, abs=0.006)
        assert (r["overtake_flag"] == "COST OVERTAKE") == (r["total_cost_mom_pct"] > r["revenue_mom_pct"])
        assert r["growth_gap"] == round(r["revenue_mom_pct"] - r["total_cost_mom_pct"], 4)


def test_unit_economics_golden(fact):
    rs = rows(ts.unit_economics(fact))
    assert len(rs) == 36
    assert pick(rs, scenario="Base", month=12)["rev_per_ride"] == pytest.approx(7.72, abs=0.006)
    assert pick(rs, scenario="High", month=12)["rev_per_ride"] == pytest.approx(15.69, abs=0.01)
    assert pick(rs, scenario="Low", month=1)["ebitda_per_vehicle"] == pytest.approx(275, abs=0.6)
    assert pick(rs, scenario="Low", month=12)["ebitda_per_vehicle"] == pytest.approx(-467, abs=0.6)
    assert pick(rs, scenario="Base", month=1)["cm_per_ride_mom_pct"] is None


def test_margin_of_safety_golden_and_dol_identity(fact):
    rs = rows(ts.margin_of_safety(fact))
    assert len(rs) == 36
    assert pick(rs, scenario="Base", month=1)["mos_pct"] == pytest.approx(89.4, abs=0.05)
    assert pick(rs, scenario="Base", month=12)["mos_pct"] == pytest.approx(88.6, abs=0.05)
    assert pick(rs, scenario="Low", month=1)["mos_pct"] == pytest.approx(31.4, abs=0.05)
    assert pick(rs, scenario="Low", month=12)["mos_pct"] == pytest.approx(-150.5, abs=0.1)
    assert pick(rs, scenario="Base", month=12)["mos_trend"] == "CONTRACTING"
    assert pick(rs, scenario="Base", month=1)["mos_trend"] is None
    dol = {(r["scenario"], r["month"]): r["dol"] for r in rows(ts.operating_leverage(fact))}
    for r in rs:
        # MoS% = EBITDA / CM = 100 / DOL
        assert r["mos_pct"] == pytest.approx(100.0 / dol[(r["scenario"], r["month"])], rel=0.02)


def test_zero_revenue_is_null_not_error(spark):
    data = [("S", 1, S.REVENUE, 0.0), ("S", 1, S.CONTRIBUTION_MARGIN, 0.0), ("S", 1, S.TOTAL_FIXED, 5.0),
            ("S", 1, S.EBITDA, -5.0), ("S", 1, S.VARIABLE_COSTS, 0.0)]
    f = spark.createDataFrame(data, "scenario string, month_number int, metric string, value double")
    r = rows(ts.margin_of_safety(f))[0]
    assert r["breakeven_revenue"] is None and r["mos_pct"] is None
    r = rows(ts.operating_leverage(f))[0]
    assert r["dol"] == 0.0 and r["fixed_cost_pct_of_total"] == 100.0


def test_unfiltered_pivot_keeps_rows_without_metrics(spark):
    data = [("S", 1, S.REVENUE, 10.0), ("S", 2, "Other", 1.0)]
    f = spark.createDataFrame(data, "scenario string, month_number int, metric string, value double")
    assert ts.operating_leverage(f).count() == 2
    assert ts.operating_leverage(f, prefilter=True).count() == 1


def test_keys_partition_independent_entities(spark):
    import fixtures as fx

    many = spark.createDataFrame(fx.fact_pdf(entities=[f"e{i}" for i in range(7)]))
    one = rows(ts.scenario_spread(spark.createDataFrame(fx.fact_pdf())), "metric", "month")
    multi = ts.scenario_spread(many, keys=["entity"])
    assert multi.count() == 7 * 36
    e3 = rows(multi.where(F.col("entity") == "e3").drop("entity"), "metric", "month")
    assert e3 == one


def test_gap_in_periods_uses_previous_row(spark):
    data = [("S", m, "EBITDA", v) for m, v in [(1, 4.0), (4, -4.0)]]
    f = spark.createDataFrame(data, "scenario string, month_number int, metric string, value double")
    r = rows(ts.zero_crossings(f, metrics=["EBITDA"]))[0]
    # LAG is the previous row; interpolation uses period - 1 (documented behaviour).
    assert r["crossing_month"] == 4 and math.isclose(r["interpolated_zero_month"], 3.5)


def test_require_contiguous_ignores_gaps(spark):
    data = [("S", m, "EBITDA", v) for m, v in [(1, 4.0), (4, -4.0), (5, 3.0)]]
    f = spark.createDataFrame(data, "scenario string, month_number int, metric string, value double")
    assert ts.zero_crossings(f, metrics=["EBITDA"]).count() == 2
    rs = rows(ts.zero_crossings(f, metrics=["EBITDA"], require_contiguous=True))
    assert [r["crossing_month"] for r in rs] == [5]


def test_require_contiguous_on_growth_and_payback(spark):
    data = []
    for m, rev, ebitda in [(1, 100.0, 1.0), (2, 110.0, 2.0), (4, 121.0, 9.0)]:
        data += [("S", m, S.REVENUE, rev), ("S", m, S.VARIABLE_COSTS, 10.0), ("S", m, S.TOTAL_FIXED, 10.0),
                 ("S", m, S.EBITDA, ebitda)]
    f = spark.createDataFrame(data, "scenario string, month_number int, metric string, value double")
    loose = {r["month"]: r for r in rows(ts.growth_overtake(f))}
    strict = {r["month"]: r for r in rows(ts.growth_overtake(f, require_contiguous=True))}
    assert loose[4]["revenue_mom_pct"] == 10.0 and strict[4]["revenue_mom_pct"] is None
    assert strict[2]["revenue_mom_pct"] == 10.0
    t = spark.createDataFrame([("S", S.TOTAL_FIXED, 5.0)], "scenario string, metric string, fy_total double")
    lp = [r for r in rows(ts.cumulative_payback(f, t)) if r["payback_flag"]]
    sp = [r for r in rows(ts.cumulative_payback(f, t, require_contiguous=True)) if r["payback_flag"]]
    assert [r["month"] for r in lp] == [4] and lp[0]["interpolated_payback"] is not None
    assert [r["month"] for r in sp] == [4] and sp[0]["interpolated_payback"] is None
