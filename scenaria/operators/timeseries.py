"""Per-period analyses of the long metric fact.

Every operator takes ``keys``: entity columns that join every grouping,
window partition and join, so one call analyses any number of independent
P&Ls. With ``keys=()`` the result is that of a single P&L.

Plan shape: one conditional-aggregation pivot, whose partial aggregate
combines rows map-side, then the (period x scenario) rows are co-located by
``keys`` (a no-op for the marts, which are already partitioned that way) and
windows partitioned by ``(keys, ...)`` run on that partitioning without
further exchanges. Lags of the same column are computed once and reused.
The fact has one row per (keys, scenario, period, metric), so rows per
entity are bounded by the period count however skewed the raw data is.

"Previous period" is the previous row, as in the reference analyses; every
operator takes ``require_contiguous=True`` to treat a predecessor across a
gap in the periods as missing instead.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.functions import exact_running_sum, linear_crossing, pct_change, safe_div
from scenaria.operators.pivot import co_locate, pivot_metrics, pivot_scenarios

PERIOD = "month_number"


def _period_window(keys: Iterable[str], *part: str) -> Window:
    return Window.partitionBy(*list(keys), *part).orderBy(PERIOD)


def _prev(col: str | Column, w: Window, require_contiguous: bool = False) -> Column:
    """Value of ``col`` in the previous row of ``w``.

    The previous row is the previous period only when periods are contiguous;
    with ``require_contiguous`` a predecessor across a gap counts as missing.
    """
    prev = F.lag(col).over(w)
    if require_contiguous:
        prev = F.when(F.lag(PERIOD).over(w) == F.col(PERIOD) - F.lit(1), prev)
    return prev


def fill_gaps(fact: DataFrame, keys: Iterable[str] = (), label_prefix: str = "Month_") -> DataFrame:
    """The fact with a row for every period between a series' first and last, and ``filled`` on the new ones.

    A missing period gets the value on the line between its neighbours in the series, by its distance from
    them; next to a NULL value it is NULL. A row that is followed by a gap makes the gap's rows itself, so
    one window per series is all it takes. Series are not extended before their first or after their last
    period; repeated periods stay as they are.
    """
    keys = list(keys)
    part = [*keys, "scenario", "metric"]
    w = _period_window(keys, "scenario", "metric")
    f = co_locate(fact, keys).select(
        *part, PERIOD, "value", F.lead(PERIOD).over(w).alias("next_period"), F.lead("value").over(w).alias("next_value")
    )
    gap = F.col("next_period") - F.col(PERIOD)
    steps = F.sequence(F.lit(0), F.greatest(F.coalesce(gap, F.lit(1)), F.lit(1)) - 1)
    f = f.withColumn("gap", gap).withColumn("i", F.explode(steps))
    value = F.when(F.col("i") == 0, F.col("value")).otherwise(
        F.col("value") + (F.col("next_value") - F.col("value")) * F.col("i") / F.col("gap")
    )
    period = (F.col(PERIOD) + F.col("i")).cast("int")
    return f.select(
        *part,
        period.alias(PERIOD),
        F.concat(F.lit(label_prefix), period.cast("string")).alias("month"),
        value.alias("value"),
        (F.col("i") > 0).alias("filled"),
    )


def scenario_spread(
    fact: DataFrame,
    metrics: Iterable[str] = (S.REVENUE, S.CONTRIBUTION_MARGIN, S.EBITDA),
    high: str = "High",
    low: str = "Low",
    base: str = "Base",
    keys: Iterable[str] = (),
    require_contiguous: bool = False,
) -> DataFrame:
    """High-minus-Low spread per period and metric, as % of Base, its growth and running total."""
    keys = list(keys)
    p = pivot_scenarios(
        fact.where(F.col("metric").isin(list(metrics))),
        {high: "high_value", base: "base_value", low: "low_value"},
        [*keys, PERIOD, "metric"],
    )
    p = co_locate(p, keys).withColumn("spread", F.col("high_value") - F.col("low_value"))
    w = _period_window(keys, "metric")
    p = p.select("*", _prev("spread", w, require_contiguous).alias("prev_spread"))
    prev = F.col("prev_spread")
    return p.select(
        *keys,
        F.col(PERIOD).alias("month"),
        "metric",
        F.round("low_value", 2).alias("low"),
        F.round("base_value", 2).alias("base"),
        F.round("high_value", 2).alias("high"),
        F.round("spread", 2).alias("spread_high_low"),
        F.round(safe_div("spread", "base_value") * F.lit(100.0), 2).alias("spread_as_pct_of_base"),
        F.round(pct_change("spread", prev), 2).alias("spread_mom_growth"),
        F.round(exact_running_sum("spread", w), 2).alias("cumulative_spread"),
    )


def zero_crossings(
    fact: DataFrame,
    metrics: Iterable[str] = (S.EBITDA, S.CONTRIBUTION_MARGIN, S.REVENUE, S.EBITDA_PCT, S.CM_PCT),
    keys: Iterable[str] = (),
    require_contiguous: bool = False,
    over_gaps: bool = False,
) -> DataFrame:
    """Sign changes between consecutive periods with linear interpolation of the zero point.

    Zero counts as non-negative: ``>= 0 -> < 0`` and ``< 0 -> >= 0`` are
    crossings. ``total_months_positive`` counts periods with value >= 0 in the
    whole series; it is a whole-partition window on the same partitioning as
    the lag, so no join and no extra exchange are needed. The predecessor is
    the previous *row*; with ``require_contiguous`` a predecessor that is not
    the immediately preceding period is ignored (no crossing across a gap);
    with ``over_gaps`` the line is drawn from the predecessor's own period, so
    a crossing over a gap of g periods interpolates over g periods.
    """
    keys = list(keys)
    part = [*keys, "scenario", "metric"]
    w = _period_window(keys, "scenario", "metric")
    step = (F.col(PERIOD) - F.lag(PERIOD).over(w)) if over_gaps else F.lit(1)
    whole = Window.partitionBy(*part)
    prev_value = _prev("value", w, require_contiguous)
    f = co_locate(fact.where(F.col("metric").isin(list(metrics))), keys).select(
        *part,
        PERIOD,
        F.col("value").alias("cur"),
        prev_value.alias("prev"),
        step.alias("step"),
        F.count(F.when(F.col("value") >= 0, F.lit(1))).over(whole).alias("total_months_positive"),
    )
    cur, prev = F.col("cur"), F.col("prev")
    if over_gaps:
        zero = (F.col(PERIOD) - F.col("step")) + F.col("step") * safe_div(F.abs(prev), F.abs(prev) + F.abs(cur))
    else:
        zero = linear_crossing(PERIOD, F.abs(prev), F.abs(prev) + F.abs(cur))
    down = (prev >= 0) & (cur < 0)
    up = (prev < 0) & (cur >= 0)
    return f.where(prev.isNotNull() & (down | up)).select(
        *part,
        F.when(down, "Positive to Negative").when(up, "Negative to Positive").alias("crossing_direction"),
        F.col(PERIOD).alias("crossing_month"),
        F.round(zero, 2).alias("interpolated_zero_month"),
        F.round(prev, 2).alias("value_before_crossing"),
        F.round(cur, 2).alias("value_after_crossing"),
        F.round(F.abs(cur - prev), 2).alias("absolute_swing"),
        "total_months_positive",
    )


def operating_leverage(
    fact: DataFrame, keys: Iterable[str] = (), prefilter: bool = False, require_contiguous: bool = False
) -> DataFrame:
    """Fixed-cost share, degree of operating leverage and the growth multiplier per period.

    The multiplier divides the already rounded growth rates.
    """
    keys = list(keys)
    p = pivot_metrics(
        fact,
        {
            S.REVENUE: "revenue",
            S.VARIABLE_COSTS: "variable_costs",
            S.TOTAL_FIXED: "fixed_costs",
            S.CONTRIBUTION_MARGIN: "contribution_margin",
            S.EBITDA: "ebitda",
        },
        [*keys, "scenario", PERIOD],
        prefilter=prefilter,
    )
    p = co_locate(p, keys)
    w = _period_window(keys, "scenario")
    p = p.select(
        "*",
        _prev("revenue", w, require_contiguous).alias("prev_revenue"),
        _prev("ebitda", w, require_contiguous).alias("prev_ebitda"),
    )
    rev_mom = F.round(pct_change("revenue", "prev_revenue"), 2)
    ebitda_mom = F.round(pct_change("ebitda", "prev_ebitda"), 2)
    return p.select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round("revenue", 2).alias("revenue"),
        F.round("fixed_costs", 2).alias("fixed_costs"),
        F.round("variable_costs", 2).alias("variable_costs"),
        F.round(safe_div("fixed_costs", F.col("variable_costs") + F.col("fixed_costs")) * F.lit(100.0), 2).alias(
            "fixed_cost_pct_of_total"
        ),
        F.round(safe_div("contribution_margin", "ebitda"), 2).alias("dol"),
        rev_mom.alias("rev_mom_pct"),
        ebitda_mom.alias("ebitda_mom_pct"),
        F.round(safe_div(ebitda_mom, rev_mom), 2).alias("leverage_multiplier"),
    )


def volume_price_mix(
    fact: DataFrame,
    value_metric: str = S.REVENUE,
    qty_metric: str = S.RIDES,
    keys: Iterable[str] = (),
    require_contiguous: bool = False,
) -> DataFrame:
    """Split the period-over-period change of revenue into volume, price and mix effects.

    volume = dQ * P0, price = dP * Q0, mix = dQ * dP with P = revenue / quantity;
    the three sum to the change. The first period (no predecessor) is dropped.
    """
    keys = list(keys)
    p = pivot_metrics(
        fact, {value_metric: "revenue", qty_metric: "rides"}, [*keys, "scenario", PERIOD], prefilter=True
    )
    p = co_locate(p, keys).withColumn("rpr", safe_div("revenue", "rides"))
    w = _period_window(keys, "scenario")
    p = p.select(
        *keys,
        "scenario",
        PERIOD,
        "revenue",
        "rides",
        "rpr",
        _prev("revenue", w, require_contiguous).alias("prev_revenue"),
        _prev("rides", w, require_contiguous).alias("prev_rides"),
        _prev("rpr", w, require_contiguous).alias("prev_rpr"),
    ).where(F.col("prev_revenue").isNotNull())
    d_q = F.col("rides") - F.col("prev_rides")
    d_p = F.col("rpr") - F.col("prev_rpr")
    total = F.col("revenue") - F.col("prev_revenue")
    volume, price, mix = d_q * F.col("prev_rpr"), d_p * F.col("prev_rides"), d_q * d_p

    def share(c):
        return F.round(safe_div(c, total) * F.lit(100.0), 2)

    return p.select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round(total, 2).alias("total_rev_change"),
        F.round(volume, 2).alias("volume_effect"),
        F.round(price, 2).alias("price_effect"),
        F.round(mix, 2).alias("mix_effect"),
        share(volume).alias("volume_pct"),
        share(price).alias("price_pct"),
        share(mix).alias("mix_pct"),
    )


def cumulative_payback(
    fact: DataFrame,
    totals: DataFrame,
    flow_metric: str = S.EBITDA,
    target_metric: str = S.TOTAL_FIXED,
    keys: Iterable[str] = (),
    first_only: bool = False,
    require_contiguous: bool = False,
) -> DataFrame:
    """Running flow against a yearly target: % recovered, upward crossings and interpolated month.

    Every upward crossing is flagged (a running total that dips below the
    target and recovers is flagged again); ``first_only`` keeps the first.
    Scenarios without a target drop out (inner join). Both join sides are
    small: one row per (keys, scenario, period) and per (keys, scenario). AQE
    broadcasts the target side when its measured size is under the threshold;
    otherwise both sides shuffle on (keys, scenario).
    """
    keys = list(keys)
    part = [*keys, "scenario"]
    w = _period_window(keys, "scenario")
    flow = co_locate(fact.where(F.col("metric") == flow_metric), keys).select(*part, PERIOD, F.col("value").alias("flow"))
    flow = flow.withColumn("cumulative", exact_running_sum("flow", w))
    flow = flow.withColumn("prev_cumulative", F.lag("cumulative").over(w))
    if require_contiguous:
        flow = flow.withColumn("contiguous", F.coalesce(F.lag(PERIOD).over(w) == F.col(PERIOD) - 1, F.lit(True)))
    target = totals.where(F.col("metric") == target_metric).select(*part, F.col("fy_total").alias("target"))
    j = flow.join(target, part)
    cum, prev, tgt = F.col("cumulative"), F.col("prev_cumulative"), F.col("target")
    hit = (cum >= tgt) & (prev.isNull() | (prev < tgt))
    if first_only:
        first = F.min(F.when(hit, F.col(PERIOD))).over(Window.partitionBy(*part))
        hit = hit & (F.col(PERIOD) == first)
    return j.select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round("flow", 2).alias("monthly_ebitda"),
        F.round(cum, 2).alias("cumulative_ebitda"),
        F.round(tgt, 2).alias("fy_fixed_cost_target"),
        F.round(safe_div(cum, tgt) * F.lit(100.0), 2).alias("pct_fixed_costs_recovered"),
        F.when(hit, F.lit("PAYBACK")).alias("payback_flag"),
        F.when(
            hit & (F.col("contiguous") if require_contiguous else F.lit(True)),
            F.round(linear_crossing(PERIOD, tgt - F.coalesce(prev, F.lit(0.0)), F.col("flow")), 2),
        ).alias("interpolated_payback"),
    )


def growth_overtake(
    fact: DataFrame, keys: Iterable[str] = (), prefilter: bool = False, require_contiguous: bool = False
) -> DataFrame:
    """Revenue vs cost growth per period; flags periods where cost growth beats revenue growth.

    Growth rates are rounded to 4 digits and the gap and flag use the rounded
    rates. The first period is removed after the windows are computed.
    """
    keys = list(keys)
    p = pivot_metrics(
        fact,
        {S.REVENUE: "revenue", S.VARIABLE_COSTS: "variable_costs", S.TOTAL_FIXED: "fixed_costs"},
        [*keys, "scenario", PERIOD],
        prefilter=prefilter,
    )
    p = co_locate(p, keys).withColumn("total_costs", F.col("variable_costs") + F.col("fixed_costs"))
    w = _period_window(keys, "scenario")

    measures = ("revenue", "total_costs", "variable_costs", "fixed_costs")
    p = p.select("*", *[_prev(c, w, require_contiguous).alias(f"prev_{c}") for c in measures])

    def growth(c):
        return F.round(pct_change(c, f"prev_{c}"), 4)

    # the first period is dropped after the lags were taken
    rev, cost = growth("revenue"), growth("total_costs")
    return p.where(F.col(PERIOD) > 1).select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round("revenue", 2).alias("revenue"),
        F.round("total_costs", 2).alias("total_costs"),
        rev.alias("revenue_mom_pct"),
        cost.alias("total_cost_mom_pct"),
        growth("variable_costs").alias("varcost_mom_pct"),
        growth("fixed_costs").alias("fixcost_mom_pct"),
        F.round(rev - cost, 4).alias("growth_gap"),
        F.when(cost > rev, F.lit("COST OVERTAKE")).alias("overtake_flag"),
    )


def unit_economics(
    fact: DataFrame, keys: Iterable[str] = (), prefilter: bool = False, require_contiguous: bool = False
) -> DataFrame:
    """Per-ride and per-vehicle ratios with the period change of contribution per ride."""
    keys = list(keys)
    p = pivot_metrics(
        fact,
        {
            S.REVENUE: "revenue",
            S.RIDES: "rides",
            S.VARIABLE_COSTS: "variable_costs",
            S.CONTRIBUTION_MARGIN: "contribution_margin",
            S.TOTAL_FIXED: "fixed_costs",
            S.EBITDA: "ebitda",
            S.FLEET: "fleet_size",
        },
        [*keys, "scenario", PERIOD],
        prefilter=prefilter,
    )
    p = co_locate(p, keys)
    w = _period_window(keys, "scenario")
    cm_per_ride = safe_div("contribution_margin", "rides")
    p = p.select(
        *keys,
        "scenario",
        PERIOD,
        safe_div("revenue", "rides").alias("rev_per_ride"),
        safe_div("variable_costs", "rides").alias("varcost_per_ride"),
        cm_per_ride.alias("cm_per_ride"),
        safe_div("fixed_costs", "rides").alias("fixcost_per_ride"),
        safe_div("ebitda", "rides").alias("ebitda_per_ride"),
        safe_div("revenue", "fleet_size").alias("rev_per_vehicle"),
        safe_div("ebitda", "fleet_size").alias("ebitda_per_vehicle"),
        safe_div("rides", "fleet_size").alias("rides_per_vehicle"),
        _prev(cm_per_ride, w, require_contiguous).alias("prev_cm_per_ride"),
    )
    prev = F.col("prev_cm_per_ride")
    return p.select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round("rev_per_ride", 4).alias("rev_per_ride"),
        F.round("varcost_per_ride", 4).alias("varcost_per_ride"),
        F.round("cm_per_ride", 4).alias("cm_per_ride"),
        F.round("fixcost_per_ride", 4).alias("fixcost_per_ride"),
        F.round("ebitda_per_ride", 4).alias("ebitda_per_ride"),
        F.round(pct_change("cm_per_ride", prev), 4).alias("cm_per_ride_mom_pct"),
        F.round(safe_div("cm_per_ride", "rev_per_ride") * F.lit(100.0), 2).alias("unit_cm_margin_pct"),
        F.round("rev_per_vehicle", 2).alias("rev_per_vehicle"),
        F.round("ebitda_per_vehicle", 2).alias("ebitda_per_vehicle"),
        F.round("rides_per_vehicle", 0).alias("rides_per_vehicle"),
    )


def margin_of_safety(
    fact: DataFrame, keys: Iterable[str] = (), prefilter: bool = False, require_contiguous: bool = False
) -> DataFrame:
    """Breakeven revenue, margin of safety (absolute and %), its trend and revenue / breakeven."""
    keys = list(keys)
    p = pivot_metrics(
        fact,
        {
            S.REVENUE: "revenue",
            S.EBITDA: "ebitda",
            S.CONTRIBUTION_MARGIN: "contribution_margin",
            S.TOTAL_FIXED: "fixed_costs",
            S.VARIABLE_COSTS: "variable_costs",
        },
        [*keys, "scenario", PERIOD],
        prefilter=prefilter,
    )
    p = co_locate(p, keys)
    breakeven = safe_div("fixed_costs", safe_div("contribution_margin", "revenue"))
    mos_abs = F.col("revenue") - breakeven
    mos_pct = safe_div(mos_abs, "revenue") * F.lit(100.0)
    p = p.select(
        *keys,
        "scenario",
        PERIOD,
        "revenue",
        breakeven.alias("breakeven"),
        mos_abs.alias("mos_abs"),
        mos_pct.alias("mos_pct"),
        safe_div(F.col("revenue"), breakeven).alias("multiple"),
    )
    w = _period_window(keys, "scenario")
    change = F.col("mos_pct") - _prev("mos_pct", w, require_contiguous)
    p = p.select("*", change.alias("mos_change"))
    ch = F.col("mos_change")
    return p.select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round("revenue", 2).alias("revenue"),
        F.round("breakeven", 2).alias("breakeven_revenue"),
        F.round("mos_abs", 2).alias("mos_absolute"),
        F.round("mos_pct", 2).alias("mos_pct"),
        F.round(ch, 4).alias("mos_mom_change_pp"),
        F.when(ch > 0, F.lit("EXPANDING")).when(ch < 0, F.lit("CONTRACTING")).alias("mos_trend"),
        F.round("multiple", 2).alias("rev_to_be_multiple"),
    )
