"""Cross-scenario portfolio views: weighted expectations, the assumption-to-result
trace, and the report marts (KPI totals, sensitivity matrix, cost structure,
margin trajectories).

Small fixed inputs (scenario weights, the driver label map, month stages)
are operator arguments compiled into literal map lookups, so they need no
join and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.functions import adaptive_round, exact_running_sum, safe_div
from scenaria.operators.pivot import co_locate, pivot_metrics, pivot_scenarios

PERIOD = "month_number"


def _lookup(mapping: Mapping, col: Column) -> Column:
    """Literal map lookup: NULL for keys not in ``mapping``."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]), col)


def _ordered_sum(term: Column) -> Column:
    """Sum of a column over the scenarios of a group in the order of their names; NULL terms do not count."""
    terms = F.array_sort(F.collect_list(F.when(term.isNotNull(), F.struct("scenario", term.alias("t")))))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x["t"])
    return F.when(F.size(terms) > 0, total)


def weighted_expectation(
    fact: DataFrame,
    weights: Mapping[str, float] | DataFrame,
    keys: Iterable[str] = (),
    base: str = "Base",
    high: str = "High",
    low: str = "Low",
) -> DataFrame:
    """Probability-weighted EBITDA, revenue and margin per period against the Base case.

    Weights are not renormalised: a scenario absent from the weights drops
    out. ``weights`` is a ``{scenario: weight}`` mapping (a literal lookup) or
    a ``(scenario, weight)`` DataFrame (joined; AQE broadcasts it when its
    measured size is small). The running total is partitioned by ``keys``.
    """
    keys = list(keys)
    m = pivot_metrics(
        fact,
        {S.EBITDA: "ebitda", S.REVENUE: "revenue", S.EBITDA_PCT: "ebitda_margin"},
        [*keys, "scenario", PERIOD],
        prefilter=True,
    )
    m = co_locate(m, keys)
    if isinstance(weights, DataFrame):
        m = m.join(weights.select("scenario", F.col("weight").cast("double").alias("weight")), "scenario")
    else:
        w_col = _lookup({k: float(v) for k, v in weights.items()}, F.col("scenario"))
        m = m.withColumn("weight", w_col).where(F.col("weight").isNotNull())
    # Weighted sums add a period's few scenarios in the order of their names, so they do not depend on
    # the order a cluster brings them in; weights and values stay as they are.
    sc = F.col("scenario")
    e, r, wt = F.col("ebitda"), F.col("revenue"), F.col("weight")
    ev = m.groupBy(*keys, PERIOD).agg(
        _ordered_sum(e * wt).alias("expected_ebitda"),
        _ordered_sum(r * wt).alias("expected_revenue"),
        F.max(F.when(sc == base, e)).alias("base_ebitda"),
        F.max(F.when(sc == base, F.col("ebitda_margin"))).alias("base_margin"),
        (F.max(F.when(sc == high, e)) - F.max(F.when(sc == low, e))).alias("ebitda_range"),
        F.max(F.when(sc == low, e * wt)).alias("weighted_low"),
    )
    exp_e, base_e = F.col("expected_ebitda"), F.col("base_ebitda")
    w = Window.partitionBy(*keys).orderBy(PERIOD)

    def money(c):
        return F.round(c, 2)

    return ev.select(
        *keys,
        F.col(PERIOD).alias("month"),
        money(exp_e).alias("expected_ebitda"),
        money(base_e).alias("base_ebitda"),
        money(exp_e - base_e).alias("exp_vs_base_delta"),
        F.round(safe_div(exp_e - base_e, base_e) * F.lit(100.0), 2).alias("exp_vs_base_pct"),
        money(F.col("expected_revenue")).alias("expected_revenue"),
        F.round(safe_div(exp_e, "expected_revenue") * F.lit(100.0), 2).alias("expected_ebitda_margin_pct"),
        F.round(F.col("base_margin") * F.lit(100.0), 2).alias("base_ebitda_margin_pct"),
        money(F.col("ebitda_range")).alias("ebitda_range_high_low"),
        money(F.col("weighted_low")).alias("prob_weighted_downside"),
        money(exact_running_sum(exp_e, w)).alias("cumulative_expected_ebitda"),
    )


# Stages of the trace: (step order, stage label, period) for periods; FY last.
MONTH_STAGES = ((10, "P&L Month 1", 1), (20, "P&L Month 12", 12))
FY_STAGE = (30, "FY Total")
STAGE_METRICS = (S.RIDES, S.REVENUE, S.VARIABLE_COSTS, S.CONTRIBUTION_MARGIN, S.TOTAL_FIXED, S.EBITDA)
FY_METRICS = STAGE_METRICS + (S.EBITDA_PCT,)


def flow_trace(
    assumptions: DataFrame,
    fact: DataFrame,
    totals: DataFrame,
    drivers: Sequence[tuple[str, str, int]],
    month_stages: Sequence[tuple[int, str, int]] = MONTH_STAGES,
    fy_stage: tuple[int, str] = FY_STAGE,
    stage_metrics: Iterable[str] = STAGE_METRICS,
    fy_metrics: Iterable[str] = FY_METRICS,
    keys: Iterable[str] = (),
    rides_metric: str = S.RIDES,
) -> DataFrame:
    """Audit trail from input drivers to period and yearly results, Low / Base / High side by side.

    ``drivers`` lists ``(driver_name, label, step_order)``; driver values are
    text and parsed with ``try_cast`` (unparseable -> NULL). Period stages
    pivot the fact at the given periods, the FY stage pivots the totals.
    Values above 10,000 in magnitude are rounded to 0 digits, others to 4;
    ``high_to_low_ratio`` is High / Low when both exist and Low is not 0.
    Driver rows are not entity-specific, so their ``keys`` are NULL.
    """
    keys = list(keys)
    label = _lookup({d: lab for d, lab, _ in drivers}, F.col("driver_name"))
    step = _lookup({d: int(o) for d, _, o in drivers}, F.col("driver_name"))
    stage1 = assumptions.select(
        step.cast("int").alias("step_order"),
        F.lit("Assumption").alias("stage"),
        label.alias("metric"),
        "unit",
        F.col("low_case").try_cast("double").alias("low"),
        F.col("base_case").try_cast("double").alias("base"),
        F.col("high_case").try_cast("double").alias("high"),
    ).where(F.col("metric").isNotNull())
    key_types = {f.name: f.dataType for f in fact.schema.fields}
    stage1 = stage1.select(*[F.lit(None).cast(key_types[k]).alias(k) for k in keys], "*")

    scen = {"Low": "low", "Base": "base", "High": "high"}
    months = [m for _, _, m in month_stages]
    mp = pivot_scenarios(
        fact.where(F.col(PERIOD).isin(months) & F.col("metric").isin(list(stage_metrics))),
        scen,
        [*keys, PERIOD, "metric"],
    )
    stage_step = _lookup({m: int(o) for o, _, m in month_stages}, F.col(PERIOD))
    stage_name = _lookup({m: n for _, n, m in month_stages}, F.col(PERIOD))
    metric = F.col("metric")
    stage23 = mp.select(
        *keys,
        stage_step.cast("int").alias("step_order"),
        stage_name.alias("stage"),
        "metric",
        F.when(metric == rides_metric, F.lit("rides")).otherwise(F.lit("€")).alias("unit"),
        "low",
        "base",
        "high",
    )
    fp = pivot_scenarios(
        totals.where(F.col("metric").isin(list(fy_metrics))),
        scen,
        [*keys, "metric"],
        value_col="fy_total",
    )
    stage4 = fp.select(
        *keys,
        F.lit(int(fy_stage[0])).alias("step_order"),
        F.lit(fy_stage[1]).alias("stage"),
        "metric",
        F.when(metric == rides_metric, F.lit("rides"))
        .when(metric.ilike("%Margin %"), F.lit("%"))
        .otherwise(F.lit("€"))
        .alias("unit"),
        "low",
        "base",
        "high",
    )
    trace = stage1.unionByName(stage23).unionByName(stage4)
    lo, hi = F.col("low"), F.col("high")
    ratio = F.when(hi.isNotNull() & lo.isNotNull() & (lo != 0), F.round(safe_div(hi, lo), 2))
    return trace.select(
        *keys,
        "step_order",
        "stage",
        "metric",
        "unit",
        adaptive_round("low").alias("low"),
        adaptive_round("base").alias("base"),
        adaptive_round("high").alias("high"),
        ratio.alias("high_to_low_ratio"),
    )


def _wide_totals(totals: DataFrame, metrics: Mapping[str, str], keys: list[str]) -> DataFrame:
    """Totals with one column per metric: as they are when they come wide, else pivoted."""
    if "metric" not in totals.columns:
        return totals.select(*keys, "scenario", *[F.col(f"`{m}`").alias(a) for m, a in metrics.items()])
    return pivot_metrics(totals, metrics, [*keys, "scenario"], value_col="fy_total", prefilter=True)


def kpi_totals(totals: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Yearly KPI table per scenario: revenue, EBITDA, margin and rides. ``totals`` may be long or wide."""
    keys = list(keys)
    metrics = {S.REVENUE: "fy_revenue", S.EBITDA: "fy_ebitda", S.EBITDA_PCT: "fy_margin", S.RIDES: "fy_rides"}
    return _wide_totals(totals, metrics, keys).select(
        *keys,
        "scenario",
        F.round("fy_revenue", 2).alias("fy_revenue"),
        F.round("fy_ebitda", 2).alias("fy_ebitda"),
        F.round(F.col("fy_margin") * F.lit(100.0), 2).alias("fy_ebitda_margin_pct"),
        F.round("fy_rides", 0).alias("fy_rides"),
    )


def level_name(axis: str, level) -> str:
    """Column name of an axis level in a matrix, e.g. ``y_0p04``."""
    return f"{axis}_{str(level).replace('.', 'p').replace('-', 'm')}"


def sensitivity_matrix(
    grid: DataFrame,
    output: str,
    y_levels: Sequence | None = None,
    keys: Iterable[str] = (),
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """One output of a grid as a matrix: rows are x levels, columns are y levels.

    Without ``y_levels`` the levels come from the data and the matrix is long: (keys, x, y, row_no, col_no,
    value), one row per position from 1, NULL where the grid has no cell. With ``y_levels`` there is one
    column per level, and a level of the data that is not listed fails the query.
    """
    keys = list(keys)
    g = grid.where(F.col("output") == output)
    if y_levels is not None:
        wanted = [F.lit(str(lv)).cast(S.AXIS) for lv in y_levels]
        cols = [
            F.max(F.when(F.col(y) == lv, F.col("value"))).alias(level_name(y, name)) for name, lv in zip(y_levels, wanted, strict=True)
        ]
        left_out = F.when(~F.col(y).isin(wanted), F.raise_error(F.lit("a level of the grid is not in y_levels")).cast("boolean"))
        wide = g.groupBy(*keys, x).agg(*cols, F.max(left_out).alias("left_out")).where("left_out IS NULL").drop("left_out")
        return wide.withColumn(x, F.col(x).cast("double"))
    # Levels of both axes are lists of their own; the positions they span meet the cells in a join.
    levels = g.groupBy(*keys).agg(F.array_sort(F.collect_set(x)).alias("_xs"), F.array_sort(F.collect_set(y)).alias("_ys"))
    places = levels.select(*keys, "_ys", F.posexplode("_xs").alias("_row", "_x")).select(*keys, "_row", "_x", F.posexplode("_ys").alias("_col", "_y"))
    cells = g.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(x).alias("_cx"), F.col(y).alias("_cy"), "value")
    match = (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return places.join(cells, match, "left").select(
        *keys,
        F.col("_x").cast("double").alias(x),
        F.col("_y").cast("double").alias(y),
        (F.col("_row") + 1).alias("row_no"),
        (F.col("_col") + 1).alias("col_no"),
        "value",
    )


def cost_structure(totals: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Yearly cost breakdown per scenario: shares of variable, vehicle and platform cost (%). ``totals`` may be long or wide."""
    keys = list(keys)
    metrics = {S.VARIABLE_COSTS: "variable", S.VEHICLE_FIXED: "vehicle", S.PLATFORM_OVERHEAD: "platform"}
    p = _wide_totals(totals, metrics, keys)
    p = p.withColumn("total", F.col("variable") + F.col("vehicle") + F.col("platform"))

    def share(c):
        return F.round(safe_div(c, "total") * F.lit(100.0), 2)

    return p.select(
        *keys,
        "scenario",
        F.round("total", 2).alias("total_costs"),
        share("variable").alias("variable_pct"),
        share("vehicle").alias("vehicle_fixed_pct"),
        share("platform").alias("platform_pct"),
    )


def margin_trajectory(fact: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Contribution and EBITDA margin (%) per scenario and period."""
    keys = list(keys)
    p = pivot_metrics(
        fact, {S.CM_PCT: "cm", S.EBITDA_PCT: "ebitda"}, [*keys, "scenario", PERIOD], prefilter=True
    )
    return p.select(
        *keys,
        "scenario",
        F.col(PERIOD).alias("month"),
        F.round(F.col("cm") * F.lit(100.0), 2).alias("cm_margin_pct"),
        F.round(F.col("ebitda") * F.lit(100.0), 2).alias("ebitda_margin_pct"),
    )
