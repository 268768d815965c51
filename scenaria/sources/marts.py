"""Planning marts derived from the warehouse tables.

The analyses run on a long metric fact, yearly totals, a driver table and
two-axis sensitivity grids. Here those are derived from the order tables so
that every analysis does work proportional to the warehouse:

* P&L keys    = customer market segment and fiscal (ship) year: one
                12-month plan per (segment, year), periods 1..12
* scenario    = line return flag (R -> Low, A -> Base, N -> High), each
                with its own variable-cost assumption
* rides       = sum of quantity; revenue = sum of price * (1 - discount)
* variable    = sum of price * (scenario variable rate + tax)
* fleet       = vehicles needed for the volume: ceil(rides / VEHICLE_CAPACITY);
                vehicle fixed = fleet * VEHICLE_COST
* the remaining metrics follow the accounting identities

Exact money: prices, quantities and rates are taken with four decimals (an
input with more fails the query instead of being rounded), so every line
amount is an integer number of 1e-8 units. Lines are summed as three 64-bit
limbs of 16, 16 and the remaining bits (codegen'd, no per-row decimal
objects) and put together as decimal once per group. The limbs hold groups of
2^42 lines of up to 9e7 currency each; a group may exceed 2^63 units by far.
The marts are bit-for-bit the same whatever order a cluster aggregates in.

Plan shape: lineitem (pruned to 8 columns, flag filter pushed to the scan)
joins orders-with-segment on the order key, so lineitem is shuffled once.
Orders and customer are large at scale; the session leaves broadcasting to
AQE's runtime size check. Every measure is a sum, so the aggregate is
partial/final: each map task emits one row per (segment, year, flag, month)
it saw, a hot group included, and the aggregate's shuffle is tiny. (A distinct
count per group, e.g. distinct suppliers, would need a second
lineitem-sized shuffle on (group, supplier), since those pairs barely
repeat within a task.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.functions import safe_div
from scenaria.sources.tables import read_table

# --- fixed values of the mart definition ---------------------------------
SCENARIO_OF_FLAG = {"R": "Low", "A": "Base", "N": "High"}
# Variable cost rate (percent of list price, before tax) assumed by each scenario.
VARIABLE_RATE_PCT = {"Low": 83, "Base": 45, "High": 30}
VEHICLE_COST = 23000
VEHICLE_CAPACITY = 200  # units shipped per vehicle per month
PLATFORM_OVERHEAD = 5000
# Grid margin also charges a handling cost per unit shipped.
UNIT_HANDLING = 100
# Sensitivity grids: x = discount, y = tax; base cell.
GRID_BASE = (0.05, 0.04)
GRID_LINESTATUS = "F"
# What-if grid: x = price growth, y = volume growth on the base cell's lines.
PRICE_GROWTH = (0.0, 0.005, 0.01, 0.015, 0.02)
VOLUME_GROWTH = (0.0, 0.01, 0.02, 0.03, 0.04)
GROWTH_BASE = (0.0, 0.0)

ENTITY = "entity"
YEAR = "fiscal_year"
PL_KEYS = (ENTITY, YEAR)  # one 12-month P&L per segment and fiscal year
MONEY = "decimal(36,8)"


def _flag_case(value_of) -> str:
    """SQL CASE over the return flag, one branch per scenario."""
    branches = " ".join(f"WHEN '{k}' THEN {value_of(sc)}" for k, sc in SCENARIO_OF_FLAG.items())
    return f"CASE l_returnflag {branches} END"


def _ten_thousandths(c: str) -> str:
    """A double with up to four decimals as an exact integer count of 1e-4; more decimals are an error."""
    u = f"{c} * 10000.0D"
    message = f"'{c} has more than four decimals'"
    return (
        f"CASE WHEN abs({u} - rint({u})) > 1e-3D + abs({c}) * 1e-11D "
        f"THEN CAST(raise_error({message}) AS BIGINT) ELSE CAST(rint({u}) AS BIGINT) END"
    )


def limb_sums(**units: str) -> list[Column]:
    """Sums of integer columns as three limbs each, ``name = column``: safe far beyond 64 bits."""
    return [
        F.sum(F.expr(e)).alias(f"{name}_{limb}")
        for name, c in units.items()
        for limb, e in (("l", f"{c} & 65535"), ("m", f"shiftright({c}, 16) & 65535"), ("h", f"shiftright({c}, 32)"))
    ]


def limbs_sql(name: str, decimals: int) -> str:
    """The sum of ``limb_sums`` as an exact decimal, in units of 10^-decimals."""
    unit = 10**decimals
    parts = (
        f"CAST({name}_{limb} AS DECIMAL(20,0)) * {weight // unit}.{weight % unit:0{decimals}d}BD"
        for limb, weight in (("h", 1 << 32), ("m", 1 << 16), ("l", 1))
    )
    return "(" + " + ".join(parts) + ")"


def sales(spark: SparkSession, sf_dir: str, by_entity: bool = True, all_lines: bool = False) -> DataFrame:
    """Line-level sales: entity, scenario, period, status, discount/tax points and integer amounts.

    ``qty_u``, ``disc_u`` and ``tax_u`` are in 1e-4; ``net_u`` and ``var_u`` are revenue and variable
    cost in 1e-8 units. The line projection is one SQL expression list (one call into the JVM);
    Catalyst prunes the scan to the columns it uses. ``all_lines`` keeps lines without a scenario
    (NULL) and lines without an order or customer, and adds ``joined``.
    """
    li = read_table(spark, sf_dir, "lineitem")
    if not all_lines:
        li = li.where(F.col("l_returnflag").isin(list(SCENARIO_OF_FLAG)))
    if by_entity:
        orders = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
        customer = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", f"c_mktsegment AS {ENTITY}")
        entities = orders.join(customer, "o_custkey").withColumn("joined", F.lit(True))
        li = li.join(entities, "l_orderkey", "left" if all_lines else "inner")
    price, disc, tax = (_ten_thousandths(c) for c in ("l_extendedprice", "l_discount", "l_tax"))
    return li.selectExpr(
        *([ENTITY] if by_entity else []),
        *(["coalesce(joined, false) AS joined"] if by_entity and all_lines else []),
        f"CAST(year(l_shipdate) AS INT) AS {YEAR}",
        "CAST(month(l_shipdate) AS INT) AS month_number",
        f"{_flag_case(lambda sc: repr(sc))} AS scenario",
        "l_linestatus",
        f"{_ten_thousandths('l_quantity')} AS qty_u",
        f"{disc} AS disc_u",
        f"{tax} AS tax_u",
        f"{price} * (10000 - {disc}) AS net_u",
        f"{price} * (CAST({_flag_case(lambda sc: VARIABLE_RATE_PCT[sc] * 100)} AS BIGINT) + {tax}) AS var_u",
    )


def _derived_sql(rides: str, net: str, var: str, fleet: str, vehicle: str, platform: str) -> list[str]:
    """The eleven metrics as SQL expressions, in the order of ``S.METRICS``; inputs are exact decimals."""

    def money(u: str) -> str:
        return f"CAST({u} AS DOUBLE)"

    fixed = f"({vehicle} + {platform})"
    cm = f"({net} - {var})"
    ebitda = f"({cm} - {fixed})"
    exprs = [
        money(fleet),
        money(rides),
        money(net),
        money(var),
        money(cm),
        f"try_divide({money(cm)}, {money(net)})",
        money(vehicle),
        money(platform),
        money(fixed),
        money(ebitda),
        f"try_divide({money(ebitda)}, {money(net)})",
    ]
    return [f"{e} AS `{m}`" for e, m in zip(exprs, S.METRICS)]


def line_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scenario, weight)``: each scenario's share of all lines that have one, to four places."""
    lines = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(list(SCENARIO_OF_FLAG)))
    counts = lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))  # a row per scenario
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    scenario = F.expr(_flag_case(lambda sc: f"'{sc}'"))
    return counts.select(scenario.alias("scenario"), F.round(share, 4).alias("weight"))


def base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (entity, fiscal year, scenario, month): exact sums and the fleet they need."""
    sums = sales(spark, sf_dir).groupBy(*PL_KEYS, "scenario", "month_number").agg(
        *limb_sums(qty="qty_u", net="net_u", var="var_u")
    )
    rides = limbs_sql("qty", 4)
    return sums.selectExpr(
        *PL_KEYS,
        "scenario",
        "month_number",
        f"CAST({rides} AS {MONEY}) AS rides",
        f"CAST({limbs_sql('net', 8)} AS {MONEY}) AS net",
        f"CAST({limbs_sql('var', 8)} AS {MONEY}) AS var",
        f"CAST(ceil(CAST({rides} AS DOUBLE) / {float(VEHICLE_CAPACITY)}D) AS BIGINT) AS fleet",
    )


def _metric_columns(fleet: str, fleet_months: str, months: str) -> list[str]:
    return _derived_sql(
        "rides",
        "net",
        "var",
        fleet,
        f"(CAST({fleet_months} AS DECIMAL(20,0)) * {VEHICLE_COST})",
        f"(CAST({months} AS DECIMAL(10,0)) * {PLATFORM_OVERHEAD})",
    )


MONTH_LABEL = "concat('Month_', CAST(month_number AS STRING)) AS month"


def wide_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide P&L: one row per (entity, fiscal year, scenario, month_number), one column per metric."""
    base = base_measures(spark, sf_dir)
    return base.selectExpr(*PL_KEYS, "scenario", "month_number", MONTH_LABEL, *_metric_columns("fleet", "fleet", "1"))


def wide_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and years of the wide P&L in one result; ``is_year`` is 1 on the yearly rows.

    One aggregate with two grouping sets over the monthly sums: a year adds up its months' exact sums
    and takes the last month's fleet. A filter on the grouping indicator cannot be pushed below the
    aggregate, so a monthly and a yearly view share one plan subtree and Spark reuses its shuffle:
    one warehouse pass, nothing materialised.
    """
    base = base_measures(spark, sf_dir).withColumn("m", F.col("month_number"))
    key = [*PL_KEYS, "scenario"]
    levels = base.groupingSets([[*key, "month_number"], key], *key, "month_number").agg(
        F.sum("rides").cast(MONEY).alias("rides"),
        F.sum("net").cast(MONEY).alias("net"),
        F.sum("var").cast(MONEY).alias("var"),
        F.max_by("fleet", "m").alias("fleet"),
        F.sum("fleet").alias("fleet_months"),
        F.count(F.lit(1)).alias("months"),
        F.grouping("month_number").cast("int").alias("is_year"),
    )
    return levels.selectExpr(
        *key, "month_number", MONTH_LABEL, "is_year", *_metric_columns("fleet", "fleet_months", "months")
    )


def wide_totals(levels: DataFrame) -> DataFrame:
    """Yearly totals, one column per metric: sums, ratio of sums for %, last fleet."""
    return levels.where(F.col("is_year") == 1).drop("month_number", "month", "is_year")


def _melt(wide: DataFrame, ids: list[str], value_name: str) -> DataFrame:
    return wide.unpivot(ids, [F.col(f"`{m}`") for m in S.METRICS], "metric", value_name)


def _long_fact(wide: DataFrame) -> DataFrame:
    long = _melt(wide, [*PL_KEYS, "scenario", "month_number", "month"], "value")
    return long.repartition(*PL_KEYS)


def _long_totals(wide: DataFrame) -> DataFrame:
    return _melt(wide, [*PL_KEYS, "scenario"], "fy_total").repartition(*PL_KEYS)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric fact (entity, fiscal_year, scenario, month_number, month, metric, value).

    Hash-partitioned by the P&L keys: the fact has (scenarios x 12 periods x
    metrics) rows per P&L whatever the raw volume, and every analysis groups
    and windows within a P&L, so they reuse this partitioning.
    """
    return _long_fact(wide_pl(spark, sf_dir))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals per (entity, fiscal_year, scenario, metric)."""
    return _long_totals(wide_totals(wide_levels(spark, sf_dir)))


def views(levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fact and totals as two views of one ``wide_levels`` result (or of a table it was written to)."""
    return _long_fact(levels.where(F.col("is_year") == 0).drop("is_year")), _long_totals(wide_totals(levels))


def fact_and_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fact and totals from one warehouse pass."""
    return views(wide_levels(spark, sf_dir))


def _cell_sums(lines: DataFrame, by: list[str]) -> DataFrame:
    """Exact revenue and cost (variable cost and handling) per group of lines."""
    sums = lines.groupBy(*by).agg(*limb_sums(qty="qty_u", net="net_u", var="var_u"))
    cost = f"{limbs_sql('var', 8)} + {limbs_sql('qty', 4)} * {UNIT_HANDLING}"
    return sums.selectExpr(*by, f"CAST({limbs_sql('net', 8)} AS {MONEY}) AS rev", f"CAST({cost} AS {MONEY}) AS cost")


def grid_cells(spark: SparkSession, sf_dir: str, by_entity: bool = False, by_status: bool = True) -> DataFrame:
    """Per (entity, discount, tax[, line status]) cell: exact revenue and cost sums.

    Cells are the levels present in the lines, whatever they are; the aggregate is partial/final, so a
    task emits one row per cell it saw.
    """
    by = [*([ENTITY] if by_entity else []), "disc_u", "tax_u", *(["l_linestatus"] if by_status else [])]
    return _cell_sums(sales(spark, sf_dir, by_entity=by_entity), by)


def grid_cells_all_and_by_status(spark: SparkSession, sf_dir: str, by_entity: bool = False) -> DataFrame:
    """Cells per line status and for all lines, from one aggregate (grouping sets).

    ``all_lines`` is 1 on the all-lines rows (status aggregated out). Both grids
    of an analysis are filters on this one result; a filter on the grouping
    indicator cannot be pushed below the aggregate, so the grid views
    share one plan subtree and Spark reuses its shuffle: one warehouse pass,
    no materialisation.
    """
    cell = [*([ENTITY] if by_entity else []), "disc_u", "tax_u"]
    part = grid_cells(spark, sf_dir, by_entity)
    return part.groupingSets([[*cell, "l_linestatus"], cell], *cell, "l_linestatus").agg(
        F.sum("rev").cast(MONEY).alias("rev"),
        F.sum("cost").cast(MONEY).alias("cost"),
        F.grouping("l_linestatus").cast("int").alias("all_lines"),
    )


def split_cells(cells: DataFrame, linestatus: str = GRID_LINESTATUS) -> tuple[DataFrame, DataFrame]:
    """The all-lines cells and the cells of one status, as views of one result."""
    all_lines = cells.where(F.col("all_lines") == 1).drop("l_linestatus", "all_lines")
    one_status = cells.where((F.col("all_lines") == 0) & (F.col("l_linestatus") == linestatus)).drop("l_linestatus", "all_lines")
    return all_lines, one_status


def _grid_rows(cells: DataFrame, keys: list[str], x: Column, y: Column, revenue: Column, margin: Column, tags) -> DataFrame:
    out = cells.select(
        *keys,
        x.cast(S.AXIS).alias("x"),
        y.cast(S.AXIS).alias("y"),
        F.array(
            F.struct(F.lit(tags[0]).alias("table"), F.lit(S.OUT_REVENUE).alias("output"), revenue.alias("value")),
            F.struct(F.lit(tags[1]).alias("table"), F.lit(S.OUT_MARGIN).alias("output"), margin.alias("value")),
        ).alias("o"),
    ).select(*keys, "x", "y", F.inline("o"))
    return out.select(*keys, "table", "output", "x", "y", "value")


def grid_from_cells(cells: DataFrame, tags: tuple[str, str] = ("1A", "1B"), by_entity: bool = False) -> DataFrame:
    """Long grid (keys, table, output, x, y, value) from cells with one row per (discount, tax)."""
    rev = F.col("rev").cast("double")
    margin = safe_div((F.col("rev") - F.col("cost")).cast("double"), rev)

    def axis(c):
        return F.col(c).cast("decimal(9,0)") * F.expr("0.0001BD")

    return _grid_rows(cells, [ENTITY] if by_entity else [], axis("disc_u"), axis("tax_u"), rev, margin, tags)


def _growth_rows(base: DataFrame, keys: list[str], tags: tuple[str, str]) -> DataFrame:
    """What-if grid on base amounts (rev, cost, fixed): price growth on x, volume growth on y."""

    def levels(values):
        return F.explode(F.array(*[F.lit(float(v)) for v in values]))

    c = base.select(*keys, "rev", "cost", "fixed", levels(PRICE_GROWTH).alias("gx")).select("*", levels(VOLUME_GROWTH).alias("gy"))
    one = F.lit(1.0)
    revenue = F.col("rev") * (one + F.col("gx")) * (one + F.col("gy"))
    margin = safe_div(revenue - F.col("cost") * (one + F.col("gy")) - F.col("fixed"), revenue)
    x, y = (F.col(g).cast("string").cast(S.AXIS) for g in ("gx", "gy"))
    return _grid_rows(c, keys, x, y, revenue, margin, tags)


def _at_grid_base() -> Column:
    x, y = (round(level * 10000) for level in GRID_BASE)
    return (F.col("disc_u") == x) & (F.col("tax_u") == y)


def growth_grid(cells: DataFrame, tags: tuple[str, str] = ("3A", "3B"), by_entity: bool = False) -> DataFrame:
    """What-if grid of the lines in the base cell of a (discount, tax) grid; its own base cell equals that cell.

    The base cell is picked by conditional aggregation, so a view that reads the same cells shares their
    subtree. Without that cell there is no grid.
    """
    keys = [ENTITY] if by_entity else []
    base = cells.groupBy(*keys).agg(*[F.max(F.when(_at_grid_base(), F.col(c))).cast("double").alias(c) for c in ("rev", "cost")])
    return _growth_rows(base.where("rev IS NOT NULL").withColumn("fixed", F.lit(0.0)), keys, tags)


def plan_growth_grid(totals_wide: DataFrame, tags: tuple[str, str] = ("4A", "4B"), scenario: str = "Base") -> DataFrame:
    """What-if grid of each plan's yearly totals in one scenario."""
    base = totals_wide.where(F.col("scenario") == scenario).select(
        *PL_KEYS,
        F.col(f"`{S.REVENUE}`").alias("rev"),
        F.col(f"`{S.VARIABLE_COSTS}`").alias("cost"),
        F.col(f"`{S.TOTAL_FIXED}`").alias("fixed"),
    )
    return _growth_rows(base, list(PL_KEYS), tags)


def replanned_growth_grid(
    spark: SparkSession,
    sf_dir: str,
    tags: tuple[str, str] = ("4A", "4B"),
    scenario: str = "Base",
    vehicle_cost: float = VEHICLE_COST,
    platform_overhead: float = PLATFORM_OVERHEAD,
    vehicle_capacity: float = VEHICLE_CAPACITY,
) -> DataFrame:
    """What-if grid of each plan, worked out anew from its months: no yearly total goes into it.

    Volume growth changes a month's units, and with them the vehicles that the month needs, rounded up month
    by month; revenue and variable cost follow units and price. The months of a plan are added up in one
    aggregate with one fleet sum for each level of volume growth, so no lattice of months is built. The
    assumptions are arguments: a grid made with others than the plan's shows in ``grid_vs_totals_check``.
    """
    months = base_measures(spark, sf_dir).where(F.col("scenario") == scenario)
    one = F.lit(1.0)

    def vehicles(growth: float) -> Column:
        return F.sum(F.ceil(F.col("rides").cast("double") * F.lit(1.0 + growth) / F.lit(float(vehicle_capacity))))

    years = months.groupBy(*PL_KEYS).agg(
        F.sum("net").cast("double").alias("rev"),
        F.sum("var").cast("double").alias("cost"),
        F.count(F.lit(1)).alias("months"),
        F.array(*[F.struct(F.lit(float(g)).alias("gy"), vehicles(g).cast("double").alias("fleet")) for g in VOLUME_GROWTH]).alias("volumes"),
    )
    cells = years.select("*", F.inline("volumes")).withColumn("gx", F.explode(F.array(*[F.lit(float(g)) for g in PRICE_GROWTH])))
    revenue = F.col("rev") * (one + F.col("gx")) * (one + F.col("gy"))
    fixed = F.col("fleet") * F.lit(float(vehicle_cost)) + F.col("months") * F.lit(float(platform_overhead))
    margin = safe_div(revenue - F.col("cost") * (one + F.col("gy")) - fixed, revenue)
    x, y = (F.col(g).cast("string").cast(S.AXIS) for g in ("gx", "gy"))
    return _grid_rows(cells, list(PL_KEYS), x, y, revenue, margin, tags)


def grids_all_and_status(
    spark: SparkSession,
    sf_dir: str,
    linestatus: str = GRID_LINESTATUS,
    tags_all: tuple[str, str] = ("1A", "1B"),
    tags_status: tuple[str, str] = ("2A", "2B"),
    by_entity: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The all-lines grid, the one-status grid and the what-if grid of the base cell, from a single warehouse pass."""
    all_lines, one_status = split_cells(grid_cells_all_and_by_status(spark, sf_dir, by_entity), linestatus)
    return (
        grid_from_cells(all_lines, tags_all, by_entity),
        grid_from_cells(one_status, tags_status, by_entity),
        growth_grid(all_lines, by_entity=by_entity),
    )


def grid(
    spark: SparkSession,
    sf_dir: str,
    linestatus: str | None = None,
    tags: tuple[str, str] = ("1A", "1B"),
    by_entity: bool = False,
) -> DataFrame:
    """Two-axis sensitivity grid over (discount, tax) with revenue and margin outputs.

    Margin = (revenue - variable cost - handling) / revenue per cell.
    ``linestatus`` restricts the slice (the second grid uses ``'F'``).
    """
    # A status filter is on a grouping key, so Catalyst pushes it to the scan.
    cells = grid_cells(spark, sf_dir, by_entity=by_entity, by_status=linestatus is not None)
    if linestatus is not None:
        cells = cells.where(F.col("l_linestatus") == linestatus)
    return grid_from_cells(cells, tags, by_entity)


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every planning table that comes from the lines: (table_name, n_rows); besides, the lines that have no
    scenario, which no table holds, and those with one that have no order or customer, which no plan holds.

    One pass: lines are counted per (plan, month, cell, status), and grouping sets over those counts
    have one row per month, year and cell of the tables.
    """
    lines = sales(spark, sf_dir, all_lines=True)
    plan = ["joined", *PL_KEYS, "scenario"]
    groups = [*plan, "month_number", "disc_u", "tax_u", "l_linestatus"]
    part = lines.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("scenario").isNotNull())
    sets = {
        "pl_monthly": ["known", *plan, "month_number"],
        "pl_fy_totals": ["known", *plan],
        "sensitivity_all_lines": ["known", "disc_u", "tax_u"],
        "sensitivity_closed_lines": ["known", "disc_u", "tax_u", "l_linestatus"],
        "sensitivity_growth": ["known", "disc_u", "tax_u"],
        "lines_without_scenario": ["known"],
        "lines_without_entity": ["known", "joined"],
    }
    columns = ["known", *groups]
    distinct_sets = [list(x) for x in dict.fromkeys(map(tuple, sets.values()))]
    cells = part.groupingSets(distinct_sets, *columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("set"))

    def set_id(cols: list[str]) -> int:
        return sum(1 << i for i, c in enumerate(reversed(columns)) if c not in cols)

    known, closed, at_base = F.col("known"), F.col("l_linestatus") == GRID_LINESTATUS, _at_grid_base()
    per_row = {
        "pl_monthly": F.when(known & F.col("joined"), len(S.METRICS)),
        "pl_fy_totals": F.when(known & F.col("joined"), len(S.METRICS)),
        "sensitivity_all_lines": F.when(known, 2),
        "sensitivity_closed_lines": F.when(known & closed, 2),
        "sensitivity_growth": F.when(known & at_base, 2 * len(PRICE_GROWTH) * len(VOLUME_GROWTH)),
        "lines_without_scenario": F.when(~known, F.col("n")),
        "lines_without_entity": F.when(known & ~F.col("joined"), F.col("n")),
    }
    totals_ = cells.agg(
        *[F.coalesce(F.sum(F.when(F.col("set") == set_id(cols), per_row[t])), F.lit(0)).cast("long").alias(t) for t, cols in sets.items()]
    )
    pairs = F.array(*[F.struct(F.lit(t).alias("table_name"), F.col(t).alias("n_rows")) for t in sets])
    return totals_.select(F.inline(pairs))


def assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver table: one driver per part type with Low/Base/High retail price, stored as text."""
    p = read_table(spark, sf_dir, "part").selectExpr(
        "p_type", "p_retailprice", f"{_ten_thousandths('p_retailprice')} AS price_u"
    )
    a = p.groupBy("p_type").agg(
        F.min("p_retailprice").alias("lo"),
        *limb_sums(price="price_u"),
        F.count(F.lit(1)).alias("parts"),
        F.max("p_retailprice").alias("hi"),
    )
    a = a.withColumn("mid", F.expr(f"CAST({limbs_sql('price', 4)} AS DOUBLE) / parts"))
    return a.select(
        F.lit("Part Pricing").alias("section"),
        F.col("p_type").alias("driver_name"),
        F.lit("EUR").alias("unit"),
        F.col("mid").cast("string").alias("base_case"),
        F.col("lo").cast("string").alias("low_case"),
        F.col("hi").cast("string").alias("high_case"),
        F.col("mid").cast("string").alias("active_value"),
    )


# Probability weights of the scenarios (25 / 50 / 25).
DEFAULT_WEIGHTS = {"Low": 0.25, "Base": 0.50, "High": 0.25}


def pl_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The P&L laid out as a sheet: per (entity, fiscal year, scenario, metric) twelve month columns.

    This is the wide layout the loader melts back into the long fact.
    """
    long = _melt(wide_pl(spark, sf_dir), [*PL_KEYS, "scenario", "month_number"], "value")
    months = [F.max(F.when(F.col("month_number") == m, F.col("value"))).alias(f"Month_{m}") for m in range(1, 13)]
    return long.groupBy(*PL_KEYS, "scenario", "metric").agg(*months)


# --- sheet-shaped exports: (keys..., sheet, row_no, c0 .. cN) of text cells -------------------
SHEET_COLUMNS = 14
PL_SHEETS = {f"P&L {s}": s for s in S.SCENARIOS}
PL_ROWS = (8, 40)  # header, metrics and decoration lie in [8, 40)
ASSUMPTION_ROWS = (("First drivers", 3, 6), ("Further drivers", 6, 1 << 30))


def _sheet_row(sheet: Column, row_no, cells: list) -> Column:
    cells = [c if isinstance(c, Column) else F.lit(c) for c in cells] + [F.lit(None)] * (SHEET_COLUMNS - len(cells))
    row_no = row_no if isinstance(row_no, Column) else F.lit(row_no)
    return F.struct(
        sheet.alias("sheet"), row_no.cast("int").alias("row_no"), *[c.cast("string").alias(f"c{i}") for i, c in enumerate(cells)]
    )


def raw_pl_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans as an export of sheets, one per (entity, fiscal year, scenario): a title, a header, one row per
    metric with its months and year, and what such sheets carry besides (dividers, blank rows, repeated
    headers, a notes sheet with the same row numbers)."""
    long = _melt(wide_levels(spark, sf_dir), [*PL_KEYS, "scenario", "month_number", "is_year"], "value")
    months = [F.max(F.when(F.col("month_number") == m, F.col("value"))).alias(f"m{m}") for m in range(1, 13)]
    wide = long.groupBy(*PL_KEYS, "scenario", "metric").agg(
        *months, F.max(F.when(F.col("is_year") == 1, F.col("value"))).alias("fy")
    )
    sheet = F.concat(F.lit("P&L "), F.col("scenario"))
    place = F.element_at(F.create_map(*[F.lit(v) for kv in ((m, 10 + 2 * i) for i, m in enumerate(S.METRICS)) for v in kv]), F.col("metric"))
    header = ["Metric", *[f"Month {m}" for m in range(1, 13)], "FY Total"]
    row = _sheet_row(sheet, place, [F.col("metric"), *[F.col(f"m{m}") for m in range(1, 13)], F.col("fy")])
    besides = [
        _sheet_row(sheet, 0, ["Profit and loss"]),
        _sheet_row(sheet, 8, header),
        _sheet_row(sheet, 13, ["── COSTS ──"]),
        _sheet_row(sheet, 15, []),
        _sheet_row(sheet, 17, header),
        _sheet_row(F.lit("Notes"), 10, [F.lit(S.METRICS[0]), "not a plan row"]),
    ]
    rows = F.when(F.col("metric") == S.METRICS[0], F.array(row, *besides)).otherwise(F.array(row))
    return wide.select(*PL_KEYS, F.inline(rows))


def raw_assumption_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver table as an export of a sheet; drivers stand in rows 3, 4, ... by name."""
    a = assumptions(spark, sf_dir)
    place = F.row_number().over(Window.orderBy("driver_name")) + 2  # one row per part type
    cells = ["driver_name", "unit", "base_case", "low_case", "high_case", "active_value"]
    row = _sheet_row(F.lit("Assumptions"), F.col("place"), [F.col(c) for c in cells])
    besides = [
        _sheet_row(F.lit("Assumptions"), 0, ["Drivers"]),
        _sheet_row(F.lit("Assumptions"), 4, []),
        _sheet_row(F.lit("Notes"), 3, ["not a driver"]),
    ]
    rows = F.when(F.col("place") == 3, F.array(row, *besides)).otherwise(F.array(row))
    return a.withColumn("place", place).select(F.inline(rows))


def raw_grid_cells(matrix: DataFrame, sheet: str) -> DataFrame:
    """A matrix (x, y, row_no, col_no, value) as an export of cells (sheet, row_no, col_no, cell): the axis
    levels stand in row 0 and column 0."""
    name = F.lit(sheet).alias("sheet")
    body = matrix.select(name, "row_no", "col_no", F.col("value").cast("string").alias("cell"))
    top = matrix.select(name, F.lit(0).alias("row_no"), "col_no", F.col("y").cast("string").alias("cell")).distinct()
    left = matrix.select(name, "row_no", F.lit(0).alias("col_no"), F.col("x").cast("string").alias("cell")).distinct()
    return body.unionByName(top).unionByName(left)


# --- exports whose parts are found by what stands in them -------------------------------------
GRID_SHEET = "Sensitivity"


def raw_grid_sheet(matrices: list[tuple[str, DataFrame]], offsets: list[tuple[int, int]]) -> DataFrame:
    """Matrices (x, y, row_no, col_no, value) in one sheet of cells: each at its own offset, under a title."""
    out = None
    for (title, matrix), (down, right) in zip(matrices, offsets, strict=True):
        cells = raw_grid_cells(matrix, GRID_SHEET)
        cells = cells.select("sheet", (F.col("row_no") + down + 1).alias("row_no"), (F.col("col_no") + right).alias("col_no"), "cell")
        head = matrix.select(F.lit(GRID_SHEET).alias("sheet"), F.lit(down).alias("row_no"), F.lit(right).alias("col_no"), F.lit(title).alias("cell"))
        cells = cells.unionByName(head.distinct())
        out = cells if out is None else out.unionByName(cells)
    return out


def raw_titled_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Price drivers of every brand and part type as sheets with a section for each brand, and their layouts.

    A sheet holds the brands that begin alike; where its sections begin depends on the data. Half of the
    sheets decorate their titles in another way. Each ends with notes that look like drivers.
    """
    part = read_table(spark, sf_dir, "part").selectExpr("p_brand", "p_type", "p_retailprice", f"{_ten_thousandths('p_retailprice')} AS price_u")
    a = part.groupBy("p_brand", "p_type").agg(
        F.min("p_retailprice").alias("lo"), *limb_sums(price="price_u"), F.count(F.lit(1)).alias("parts"), F.max("p_retailprice").alias("hi")
    )
    sheet = F.expr("concat('Prices ', substring(p_brand, 1, length(p_brand) - 1))")
    a = a.withColumn("sheet", sheet).withColumn("mid", F.expr(f"CAST({limbs_sql('price', 4)} AS DOUBLE) / parts"))
    row = lambda kind, *cells: F.struct(F.lit(kind).alias("kind"), *[(c if isinstance(c, Column) else F.lit(c)).cast("string").alias(f"c{i}") for i, c in enumerate(cells)])
    empty = [None] * 5
    even = F.crc32(F.col("sheet").cast("binary")) % 2 == 0
    title = F.when(even, F.concat(F.lit("── "), F.upper("p_brand"), F.lit(" ──"))).otherwise(F.concat("p_brand", F.lit(":")))
    drivers = a.select("sheet", "p_brand", "p_type", "parts", F.inline(F.array(row(2, F.col("p_type"), "EUR", F.col("mid"), F.col("lo"), F.col("hi"), F.col("mid")))))
    brands = a.groupBy("sheet", "p_brand").agg(F.lit(None).cast("string").alias("p_type"), F.sum("parts").alias("parts"))
    frames = brands.select("*", F.inline(F.array(
        row(0, title, *empty),
        row(1, "Driver Name", "Unit", "Base", "Low", "High", "Active"),
        row(3, None, *empty),
    )))
    ends = brands.groupBy("sheet").agg(F.lit("~").alias("p_brand"), F.lit(None).cast("string").alias("p_type"), F.sum("parts").alias("parts"))
    ends = ends.select("*", F.inline(F.array(row(0, "NOTES", *empty), row(2, "not a driver", "EUR", "1", "1", "1", "1"))))
    rows = drivers.unionByName(frames).unionByName(ends)
    sheets = Window.partitionBy("sheet")  # some rows per brand and part type
    above = F.sum("parts").over(sheets) % 7
    place = F.row_number().over(sheets.orderBy("p_brand", "kind", "p_type")) + above
    raw = rows.select("sheet", place.cast("int").alias("row_no"), *[f"c{i}" for i in range(6)])
    layout = brands.select("sheet", F.col("p_brand").alias("title"), F.col("p_brand").alias("section"))
    return raw, layout.unionByName(brands.select("sheet", F.lit("Notes").alias("title"), F.lit(None).cast("string").alias("section")).distinct())


ORDERS_CSV = "o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING"


def export_orders(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The orders as delimited text; of some, spoilt lines stand besides: a value too few, a price or key that is none."""
    o = read_table(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    text = {n: F.col(n).cast("string").alias(n) for n in names}
    line = lambda **other: F.to_csv(F.struct(*[other.get(n, text[n]).alias(n) for n in names]), {"escape": '"'})
    spoilt = F.when(F.col("o_orderkey") % 97 == 0, F.to_csv(F.struct(*[text[n] for n in names[:-1]]), {"escape": '"'}))
    spoilt = spoilt.when(F.col("o_orderkey") % 101 == 0, line(o_totalprice=F.lit("n/a")))
    spoilt = spoilt.when(F.col("o_orderkey") % 103 == 0, line(o_orderkey=F.lit("?")))
    lines = o.select(F.explode(F.array_compact(F.array(line(), spoilt))).alias("value"))
    lines.write.mode("overwrite").text(path)


def fact_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long fact without some months of each plan, other ones by scenario."""
    return fact(spark, sf_dir).where((F.col("month_number") + F.length("scenario")) % 4 != 0)


SUPPLIER_GRID_KEYS = ("l_suppkey", YEAR)


def supplier_lines_as_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each supplier and year as rows of a grid over discount and tax: cells repeat and are missing."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_suppkey",
        F.year("l_shipdate").alias(YEAR),
        F.col("l_discount").cast("string").cast(S.AXIS).alias("x"),
        F.col("l_tax").cast("string").cast(S.AXIS).alias("y"),
        F.lit(S.OUT_REVENUE).alias("output"),
        F.col("l_extendedprice").alias("value"),
    )


#: Sheet, title, table and the steps of the four engines, as (metric, unit, definition, expression).
ENGINES = (
    ("Volume Engine", "Volume", "volume_engine", ((S.FLEET, "vehicles", "at the year's end", S.FLEET), (S.RIDES, "rides", "of the year", S.RIDES))),
    ("Revenue Engine", "Revenue", "revenue_engine", ((S.REVENUE, "EUR", "after discounts", S.REVENUE),)),
    ("Variable Cost Engine", "Variable Costs", "variable_cost_engine", ((S.VARIABLE_COSTS, "EUR", "with the volume", S.VARIABLE_COSTS), (S.CONTRIBUTION_MARGIN, "EUR", "revenue less variable costs", S.CONTRIBUTION_MARGIN))),
    ("Fixed Cost Engine", "Fixed Costs", "fixed_cost_engine", ((S.VEHICLE_FIXED, "EUR", "fleet", S.VEHICLE_FIXED), (S.PLATFORM_OVERHEAD, "EUR", "every month", S.PLATFORM_OVERHEAD), (S.EBITDA, "EUR", "what is left", S.EBITDA))),
)


def raw_engine_sheets(spark: SparkSession, sf_dir: str, scenario: str = "Base") -> tuple[DataFrame, DataFrame]:
    """The calculation steps of each plan's year as sheets, one for each engine, and their layout.

    Under its title a sheet has a header, its steps with dividers and blank rows between, and the header
    once more; notes follow.
    """
    years = wide_totals(wide_levels(spark, sf_dir)).where(F.col("scenario") == scenario)
    rows = []
    for sheet, title, _, steps in ENGINES:
        lines = [["Engine of the year", "see notes"], [f"── {title.upper()} ──"], ["Metric", "Unit", "Definition", "Value"]]
        for i, (metric, unit, definition, column) in enumerate(steps):
            lines += [[metric, unit, definition, F.col(f"`{column}`")], [f"── step {i + 1} ──", "", ""], []]
        lines += [["Metric", "Unit", "Definition", "Value"], ["Notes:"], ["not a step", "EUR", "", "1"]]
        rows += [_sheet_row(F.lit(sheet), i, cells) for i, cells in enumerate(lines)]
    raw = years.select(*PL_KEYS, F.inline(F.array(*rows)))
    known = [(sheet, t, s) for sheet, title, table, _ in ENGINES for t, s in ((title, table), ("Notes", None))]
    return raw, spark.createDataFrame(known, "sheet string, title string, section string")
