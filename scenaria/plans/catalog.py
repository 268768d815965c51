"""The named analyses: each is ``(spark, sf_dir) -> DataFrame`` over the warehouse tables.

Every analysis is run per entity (customer segment), so the entity key joins
every grouping and window. Operators return unsorted DataFrames; ordering
is a presentation concern.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.operators import audit as au
from scenaria.operators import grid as gr
from scenaria.operators import portfolio as pf
from scenaria.operators import timeseries as ts
from scenaria.session import checkpoint_dir
from scenaria.sources import delimited, layout, marts, reshape, sinks, snapshots
from scenaria.sources.tables import read_table

KEYS = marts.PL_KEYS  # P&L analyses: one 12-month plan per (segment, fiscal year)
GRID_KEYS = (marts.ENTITY,)  # grid analyses: one grid per segment

Query = Callable[[SparkSession, str], DataFrame]


def scenario_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-Low spread of revenue, contribution margin and EBITDA per month."""
    return ts.scenario_spread(marts.fact(spark, sf_dir), keys=KEYS)


def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-line crossings of five P&L lines with interpolated crossing month."""
    return ts.zero_crossings(marts.fact(spark, sf_dir), keys=KEYS)


def operating_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-cost share, DOL and leverage multiplier per scenario-month."""
    return ts.operating_leverage(marts.fact(spark, sf_dir), keys=KEYS)


def volume_price_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue change split into volume, price and mix effects."""
    return ts.volume_price_mix(marts.fact(spark, sf_dir), keys=KEYS)


def cumulative_payback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running EBITDA against the yearly fixed-cost target with payback month."""
    fact, totals = marts.fact_and_totals(spark, sf_dir)
    return ts.cumulative_payback(fact, totals, keys=KEYS)


def payback_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative payback that flags a plan's first upward crossing only."""
    fact, totals = marts.fact_and_totals(spark, sf_dir)
    return ts.cumulative_payback(fact, totals, keys=KEYS, first_only=True)


def growth_overtake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue vs cost growth; flags months where costs grow faster."""
    return ts.growth_overtake(marts.fact(spark, sf_dir), keys=KEYS)


def unit_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-ride and per-vehicle economics with contribution-per-ride trend."""
    return ts.unit_economics(marts.fact(spark, sf_dir), keys=KEYS)


def margin_of_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakeven revenue and margin of safety with its trend."""
    return ts.margin_of_safety(marts.fact(spark, sf_dir), keys=KEYS)


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The grids of all lines, of closed lines, and of growth on the base cell, from one warehouse pass."""
    return marts.grids_all_and_status(spark, sf_dir)


def grid_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial derivatives of margin and revenue on the (discount, tax) grid per segment."""
    g = marts.grid(spark, sf_dir, by_entity=True)
    return gr.grid_sensitivity(g, step_x=0.01, step_y=0.01, x_label="Discount", y_label="Tax", keys=GRID_KEYS)


def lever_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-at-a-time ranking of four levers over two grids with different axes and a common base cell."""
    all_lines, _, growth = _grids(spark, sf_dir)
    return gr.lever_ranking(
        [
            gr.GridLevers(all_lines, "Discount", "Tax", *marts.GRID_BASE),
            gr.GridLevers(growth, "Price_Growth", "Volume_Growth", *marts.GROWTH_BASE),
        ]
    )


def interaction_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction of discount and tax on the closed-line grid per segment."""
    g = marts.grid(spark, sf_dir, linestatus=marts.GRID_LINESTATUS, tags=("2A", "2B"), by_entity=True)
    return gr.interaction_effects(g, keys=GRID_KEYS)


# The six part-type drivers traced from assumption to result.
DRIVERS = (
    ("ECONOMY", "Economy Part Price", 1),
    ("LARGE", "Large Part Price", 2),
    ("MEDIUM", "Medium Part Price", 3),
    ("PROMO", "Promo Part Price", 4),
    ("SMALL", "Small Part Price", 5),
    ("STANDARD", "Standard Part Price", 6),
)


def flow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers -> month 1 / month 12 / FY results, Low / Base / High with High/Low ratio."""
    fact, totals = marts.fact_and_totals(spark, sf_dir)
    trace = pf.flow_trace(marts.assumptions(spark, sf_dir), fact, totals, DRIVERS, keys=KEYS)
    # Key columns label the plan (NULL on the global driver rows): report them as text.
    return trace.withColumn(marts.YEAR, F.col(marts.YEAR).cast("string"))


def weighted_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability-weighted EBITDA (25/50/25) against Base per month."""
    return pf.weighted_expectation(marts.fact(spark, sf_dir), marts.DEFAULT_WEIGHTS, keys=KEYS)


def weighted_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected EBITDA per month with weights from a table: each scenario's share of all lines."""
    return pf.weighted_expectation(marts.fact(spark, sf_dir), marts.line_shares(spark, sf_dir), keys=KEYS)


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five accounting identities per scenario-month with PASS / FAIL."""
    return au.reconcile(marts.fact(spark, sf_dir), keys=KEYS)


def reconcile_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounting identities, with INCOMPLETE for rows that lack a metric."""
    return au.reconcile(marts.fact(spark, sf_dir), strict=True, keys=KEYS)


def grid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness and duplicates of the three grids, cross-check of the two that share a base cell."""
    all_lines, closed, growth = _grids(spark, sf_dir)
    return au.grid_audit(
        [
            au.AuditGrid("all_lines", all_lines, *marts.GRID_BASE),
            au.AuditGrid("closed_lines", closed, *marts.GRID_BASE),
            au.AuditGrid("growth", growth, *marts.GROWTH_BASE),
        ],
        cross_check=(0, 2),
    )


def grid_vs_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base cell of each plan's growth grid against the plan's yearly totals."""
    levels = marts.wide_levels(spark, sf_dir)
    _, totals = marts.views(levels)
    growth = marts.plan_growth_grid(marts.wide_totals(levels))
    return au.grid_vs_totals_check(growth, totals, *marts.GROWTH_BASE, keys=KEYS)


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand on several lines of one order."""
    return au.assert_unique(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


def kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly KPI table per segment and scenario."""
    return pf.kpi_totals(marts.wide_totals(marts.wide_levels(spark, sf_dir)), keys=KEYS)


def sensitivity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin grid as a discount x tax matrix over all levels present, in long form."""
    return pf.sensitivity_matrix(marts.grid(spark, sf_dir), S.OUT_MARGIN)


def flatten_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix sheets of both grid outputs flattened back into long grid rows, levels read from the sheets."""
    g = marts.grid(spark, sf_dir)  # both matrices read the same subtree: one pass, shuffle reused
    sheets = {"Revenue": ("1A", S.OUT_REVENUE), "Margin": ("1B", S.OUT_MARGIN)}
    cells = [marts.raw_grid_cells(pf.sensitivity_matrix(g, out), sheet) for sheet, (_, out) in sheets.items()]
    long = reshape.cells_to_grid(cells[0].unionByName(cells[1]), sheets)
    return long.select("table", "output", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "value")


def cost_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly cost shares per segment and scenario."""
    return pf.cost_structure(marts.wide_totals(marts.wide_levels(spark, sf_dir)), keys=KEYS)


def margin_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM % and EBITDA % per segment, scenario and month."""
    return pf.margin_trajectory(marts.fact(spark, sf_dir), keys=KEYS)


def unpivot_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The P&L sheet (12 month columns per segment-year) melted back into the long fact."""
    sheet = marts.pl_sheet(spark, sf_dir)
    months = [f"Month_{m}" for m in range(1, 13)]
    return reshape.melt_periods(sheet, [*KEYS, "scenario", "metric"], months)


def load_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver table loaded from its sheet: sections, positional names, empty rows dropped."""
    raw = marts.raw_assumption_sheet(spark, sf_dir)
    return reshape.assumptions_from_sheet(raw, marts.ASSUMPTION_ROWS, sheet="Assumptions")


def _pl_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = reshape.tag_snapshots(marts.raw_pl_sheets(spark, sf_dir), marts.PL_SHEETS)
    return reshape.pl_from_sheet(raw, *marts.PL_ROWS, S.METRICS, sheet=list(marts.PL_SHEETS), keys=[*KEYS, "scenario"])


def load_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long fact loaded from the plans' sheets, one snapshot per scenario."""
    return _pl_sheets(spark, sf_dir)[0]


def load_fy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly totals loaded from the plans' sheets."""
    return _pl_sheets(spark, sf_dir)[1]


def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of every planning table derived from the warehouse, and of lines that none of them can hold."""
    return marts.table_counts(spark, sf_dir).unionByName(au.load_audit({"assumptions": marts.assumptions(spark, sf_dir)}))


# Table and output of the four blocks of the sensitivity sheet, in reading order.
GRID_BLOCKS = (("1A", S.OUT_REVENUE), ("2A", S.OUT_REVENUE), ("1B", S.OUT_MARGIN), ("2B", S.OUT_MARGIN))


def load_grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sensitivity grids from one sheet with four matrix blocks, found between its blank rows and columns."""
    all_lines, closed, _ = _grids(spark, sf_dir)
    of = {"1": all_lines, "2": closed}
    matrices = [(f"Table {t}", pf.sensitivity_matrix(of[t[0]], out)) for t, out in GRID_BLOCKS]
    # Two beside and two below, none in line with another; a matrix has room for 900 levels.
    sheet = layout.saved(marts.raw_grid_sheet(matrices, [(3, 2), (5, 1000), (1001, 7), (1002, 1003)]), "sheet")
    long = layout.blocks_to_grid(sheet, {marts.GRID_SHEET: GRID_BLOCKS})
    return long.select("table", "output", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "value")


def load_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price drivers by brand, loaded from sheets whose sections are found from their titles."""
    raw, layouts = marts.raw_titled_sheets(spark, sf_dir)
    t = layout.assumptions_by_title(raw, layouts)
    cases = ("base_case", "low_case", "high_case", "active_value")
    return t.select("section", "driver_name", "unit", *[F.col(c).try_cast("double").alias(c) for c in cases])


def _orders_csv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    root = f"{checkpoint_dir(spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    marts.export_orders(spark, sf_dir, f"{root}/export")
    return delimited.load(spark, f"{root}/export", marts.ORDERS_CSV, f"{root}/loaded")


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders loaded from a delimited export with spoilt lines among them: the good rows, typed."""
    rows, _, _ = _orders_csv(spark, sf_dir)
    return rows.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def csv_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a delimited load: the good ones as counted by the write, the bad ones by reason."""
    _, bad, counts = _orders_csv(spark, sf_dir)
    loaded = spark.createDataFrame([("orders", "loaded", counts["n_good"])], "table_name string, reason string, n_rows bigint")
    return loaded.unionByName(bad.groupBy(F.lit("orders").alias("table_name"), F.col(delimited.REASON).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows")))


def reload_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long fact after its three scenarios were loaded one by one and Low was loaded again, at half its values."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/fact-{uuid.uuid4().hex}"
    sinks.write_table(marts.fact(spark, sf_dir), f"{root}/derived")
    fact = spark.read.parquet(f"{root}/derived")
    table = snapshots.SnapshotTable(spark, f"{root}/table")
    for s in S.SCENARIOS:
        table.replace(s, fact.where(F.col("scenario") == s))
    table.replace("Low", fact.where(F.col("scenario") == "Low").withColumn("value", F.col("value") / 2))
    return table.read()


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the planning tables, taken by the jobs that write them."""
    return sinks.loaded_counts(spark, sinks.load_planning_tables(spark, sf_dir))


def bucketed_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounting identities on a fact table bucketed by the plan keys: read without an exchange."""
    name = f"fact_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return au.reconcile(sinks.write_bucketed(marts.fact(spark, sf_dir), name, path, KEYS, buckets, ["month_number"]), keys=KEYS)


def gap_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-line crossings of plans with missing months, interpolated over as many months as lie between."""
    return ts.zero_crossings(marts.fact_with_gaps(spark, sf_dir), keys=KEYS, over_gaps=True)


def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans with missing months, these filled by the line between their neighbours."""
    return ts.fill_gaps(marts.fact_with_gaps(spark, sf_dir), keys=KEYS)


def grid_cells_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and doubled cells of each supplier's yearly (discount, tax) grid, whose rows are its lines."""
    found = au.grid_cells_check(marts.supplier_lines_as_cells(spark, sf_dir), marts.SUPPLIER_GRID_KEYS)
    return found.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))


def load_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step tables of the four engines of each plan, loaded from their sheets by title."""
    raw, layouts = marts.raw_engine_sheets(spark, sf_dir)
    t = layout.engines_by_title(raw, layouts, KEYS)
    return t.withColumn("value", F.col("value").try_cast("double"))


def replanned_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth grid of each plan, worked out anew from its months at every level."""
    g = marts.replanned_growth_grid(spark, sf_dir)
    return g.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))


def replanned_vs_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base cells of replanned growth grids against the yearly totals: one with the plan's assumptions, one with dearer vehicles."""
    _, totals = marts.views(marts.wide_levels(spark, sf_dir))
    cases = {"as planned": marts.VEHICLE_COST, "vehicles at 1.1 times the cost": 1.1 * marts.VEHICLE_COST}
    out = None
    for name, cost in cases.items():
        g = marts.replanned_growth_grid(spark, sf_dir, vehicle_cost=cost).withColumn("assumption", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return au.grid_vs_totals_check(out, totals, *marts.GROWTH_BASE, keys=KEYS, tags=("assumption",))


# Presentation order of each analysis (operators return unsorted frames; sorting
# is only done here, at the edge, for display or export).
ORDER = {
    "scenario_spread": ("entity", "fiscal_year", "metric", "month"),
    "zero_crossings": ("entity", "fiscal_year", "scenario", "metric", "crossing_month"),
    "operating_leverage": ("entity", "fiscal_year", "scenario", "month"),
    "volume_price_mix": ("entity", "fiscal_year", "scenario", "month"),
    "cumulative_payback": ("entity", "fiscal_year", "scenario", "month"),
    "growth_overtake": ("entity", "fiscal_year", "scenario", "month"),
    "unit_economics": ("entity", "fiscal_year", "scenario", "month"),
    "margin_of_safety": ("entity", "fiscal_year", "scenario", "month"),
    "grid_sensitivity": ("entity", "x", "y"),
    "lever_ranking": ("output", "impact_rank"),
    "interaction_effects": ("entity", "output", "x", "y"),
    "flow_trace": ("entity", "fiscal_year", "step_order", "stage", "metric"),
    "weighted_expectation": ("entity", "fiscal_year", "month"),
    "weighted_by_lines": ("entity", "fiscal_year", "month"),
    "payback_first": ("entity", "fiscal_year", "scenario", "month"),
    "reconcile": ("entity", "fiscal_year", "scenario", "month"),
    "reconcile_strict": ("entity", "fiscal_year", "scenario", "month"),
    "grid_audit": ("audit_check", "table_name"),
    "grid_vs_totals": ("entity", "fiscal_year", "output"),
    "duplicate_lines": ("l_orderkey", "l_partkey"),
    "load_assumptions": ("driver_name",),
    "load_pl": ("entity", "fiscal_year", "scenario", "metric", "month_number"),
    "load_fy_totals": ("entity", "fiscal_year", "scenario", "metric"),
    "kpi_totals": ("entity", "fiscal_year", "scenario"),
    "sensitivity_matrix": ("x", "y"),
    "flatten_grid": ("output", "x", "y"),
    "cost_structure": ("entity", "fiscal_year", "scenario"),
    "margin_trajectory": ("entity", "fiscal_year", "scenario", "month"),
    "unpivot_fact": ("entity", "fiscal_year", "scenario", "metric", "month_number"),
    "load_audit": ("table_name",),
    "load_grid_blocks": ("table", "output", "x", "y"),
    "load_titled": ("section", "driver_name"),
    "load_csv": ("o_orderkey",),
    "csv_audit": ("table_name", "reason"),
    "reload_scenario": ("entity", "fiscal_year", "scenario", "metric", "month_number"),
    "load_counts": ("table_name",),
    "bucketed_reconcile": ("entity", "fiscal_year", "scenario", "month"),
    "load_engines": ("entity", "fiscal_year", "section", "metric"),
    "replanned_grid": ("entity", "fiscal_year", "output", "x", "y"),
    "replanned_vs_totals": ("entity", "fiscal_year", "assumption", "output"),
    "gap_crossings": ("entity", "fiscal_year", "scenario", "metric", "crossing_month"),
    "filled_gaps": ("entity", "fiscal_year", "scenario", "metric", "month_number"),
    "grid_cells_check": ("l_suppkey", "fiscal_year", "x", "y"),
}


def present(df: DataFrame, name: str) -> DataFrame:
    """The analysis result in its report order (a global sort: use for display/export only)."""
    order = ORDER.get(name)
    return df.orderBy(*order) if order else df


QUERIES: dict[str, Query] = {
    "scenario_spread": scenario_spread,
    "zero_crossings": zero_crossings,
    "operating_leverage": operating_leverage,
    "volume_price_mix": volume_price_mix,
    "cumulative_payback": cumulative_payback,
    "growth_overtake": growth_overtake,
    "unit_economics": unit_economics,
    "margin_of_safety": margin_of_safety,
    "grid_sensitivity": grid_sensitivity,
    "lever_ranking": lever_ranking,
    "interaction_effects": interaction_effects,
    "flow_trace": flow_trace,
    "weighted_expectation": weighted_expectation,
    "weighted_by_lines": weighted_by_lines,
    "reconcile": reconcile,
    "grid_audit": grid_audit,
    "kpi_totals": kpi_totals,
    "sensitivity_matrix": sensitivity_matrix,
    "flatten_grid": flatten_grid,
    "cost_structure": cost_structure,
    "margin_trajectory": margin_trajectory,
    "unpivot_fact": unpivot_fact,
    "load_audit": load_audit,
    "load_assumptions": load_assumptions,
    "load_pl": load_pl,
    "load_fy_totals": load_fy_totals,
    "payback_first": payback_first,
    "reconcile_strict": reconcile_strict,
    "grid_vs_totals": grid_vs_totals,
    "duplicate_lines": duplicate_lines,
    "load_grid_blocks": load_grid_blocks,
    "load_titled": load_titled,
    "load_csv": load_csv,
    "csv_audit": csv_audit,
    "reload_scenario": reload_scenario,
    "load_counts": load_counts,
    "bucketed_reconcile": bucketed_reconcile,
    "load_engines": load_engines,
    "replanned_grid": replanned_grid,
    "replanned_vs_totals": replanned_vs_totals,
    "gap_crossings": gap_crossings,
    "filled_gaps": filled_gaps,
    "grid_cells_check": grid_cells_check,
}
