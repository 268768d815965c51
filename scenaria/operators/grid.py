"""Analyses of two-axis sensitivity grids.

A grid is ``(keys..., output, x, y, value)``: one output value per cell of
two input axes. Axis levels are decimals so equality tests are exact.

Plan shape: a grid holds at most (#x levels * #y levels * #outputs) rows per
entity. With entity keys the operators hash-partition by the keys once and
compute every neighbour or reference-cell lookup as a window on that
partitioning; a single grid (no keys) is a few hundred rows, and each window
spec plans its own small exchange. No joins, no broadcasts: the work and the
shuffle grow linearly with the number of entities.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.functions import round_by_output, safe_div


def _axis(v) -> Column:
    return F.lit(str(v)).cast(S.AXIS)


def _by_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Co-locate rows by ``cols`` once so every window below reuses the partitioning."""
    return df.repartition(*cols) if cols else df


def grid_sensitivity(
    grid: DataFrame,
    out_a: str = S.OUT_MARGIN,
    out_b: str = S.OUT_REVENUE,
    step_x: float = 0.04,
    step_y: float = 0.075,
    x_label: str = "Price",
    y_label: str = "Utilization",
    keys: Iterable[str] = (),
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Backward-difference partial derivatives of two outputs along both axes.

    For each cell: d(out)/dx against the previous x level at the same y, and
    d(out)/dy against the previous y level at the same x (per 1.0 axis unit);
    NULL at the first level of an axis. The dominant lever compares
    ``|d out_a/dx| * step_x`` with ``|d out_a/dy| * step_y`` with NULL as 0,
    so edge cells lose by construction; ``lever_comparable`` marks cells
    where both derivatives exist. A cell needs both outputs.
    """
    keys = list(keys)
    out = F.col("output")
    cells = _by_keys(grid, keys).groupBy(*keys, x, y).agg(
        F.max(F.when(out == out_a, F.col("value"))).alias("a"),
        F.max(F.when(out == out_b, F.col("value"))).alias("b"),
        F.count(F.when(out == out_a, F.lit(1))).alias("n_a"),
        F.count(F.when(out == out_b, F.lit(1))).alias("n_b"),
    ).where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    wx = Window.partitionBy(*keys, y).orderBy(x)
    wy = Window.partitionBy(*keys, x).orderBy(y)
    cells = cells.select(
        *keys,
        x,
        y,
        "a",
        "b",
        F.lag("a").over(wx).alias("a_px"),
        F.lag("b").over(wx).alias("b_px"),
        F.lag(x).over(wx).alias("x_p"),
        F.lag("a").over(wy).alias("a_py"),
        F.lag("b").over(wy).alias("b_py"),
        F.lag(y).over(wy).alias("y_p"),
    )
    dx = (F.col(x) - F.col("x_p")).cast("double")
    dy = (F.col(y) - F.col("y_p")).cast("double")
    da_dx = safe_div(F.col("a") - F.col("a_px"), dx)
    da_dy = safe_div(F.col("a") - F.col("a_py"), dy)
    db_dx = safe_div(F.col("b") - F.col("b_px"), dx)
    db_dy = safe_div(F.col("b") - F.col("b_py"), dy)
    price_wins = F.abs(F.coalesce(da_dx, F.lit(0.0))) * F.lit(float(step_x)) > F.abs(
        F.coalesce(da_dy, F.lit(0.0))
    ) * F.lit(float(step_y))
    return cells.select(
        *keys,
        F.col(x).cast("double").alias(x),
        F.col(y).cast("double").alias(y),
        F.round(F.col("a") * F.lit(100.0), 2).alias("ebitda_margin_pct"),
        F.round("b", 0).alias("net_revenue"),
        F.round(da_dx, 4).alias("dmargin_dx"),
        F.round(da_dy, 4).alias("dmargin_dy"),
        F.round(db_dx, 0).alias("drevenue_dx"),
        F.round(db_dy, 0).alias("drevenue_dy"),
        F.when(price_wins, F.lit(x_label)).otherwise(F.lit(y_label)).alias("dominant_margin_lever"),
        (da_dx.isNotNull() & da_dy.isNotNull()).alias("lever_comparable"),
    )


@dataclass(frozen=True)
class GridLevers:
    """A grid with the names of its two levers and its base cell."""

    grid: DataFrame
    x_lever: str
    y_lever: str
    base_x: float
    base_y: float
    x: str = "x"
    y: str = "y"


def _lever_rows(g: GridLevers, keys: list[str], base_values: Mapping[str, float] | None) -> DataFrame:
    x, y = F.col(g.x), F.col(g.y)
    bx, by = _axis(g.base_x), _axis(g.base_y)
    # Only the two lines through the base cell matter: prune before any shuffle.
    rows = g.grid.where((x == bx) | (y == by)).select(*keys, "output", g.x, g.y, "value")
    if base_values is None:
        base = F.max(F.when((x == bx) & (y == by), F.col("value"))).over(Window.partitionBy(*keys, "output"))
    else:
        base = F.element_at(
            F.create_map(*[F.lit(v) for kv in base_values.items() for v in kv]), F.col("output")
        ).cast("double")
    levers = F.array(
        F.struct(
            F.lit(g.x_lever).alias("lever"),
            (x - bx).cast("double").alias("step"),
            ((y == by) & (x != bx)).alias("on_line"),
        ),
        F.struct(
            F.lit(g.y_lever).alias("lever"),
            (y - by).cast("double").alias("step"),
            ((x == bx) & (y != by)).alias("on_line"),
        ),
    )
    rows = rows.select(*keys, "output", "value", base.alias("base_value"), F.inline(levers))
    rows = rows.where(F.col("on_line") & F.col("base_value").isNotNull())
    delta = F.col("value") - F.col("base_value")
    return rows.select(
        *keys,
        "lever",
        "output",
        delta.alias("delta"),
        safe_div(delta, F.col("step")).alias("delta_per_unit"),
    )


def lever_ranking(
    grids: Sequence[GridLevers],
    base_values: Mapping[str, float] | None = None,
    coarse_outputs: Iterable[str] = (S.OUT_REVENUE,),
    keys: Iterable[str] = (),
) -> DataFrame:
    """One-at-a-time sensitivity of each lever, ranked within each output.

    For every grid, cells on the line through the base cell along one axis
    (the other axis at base, this axis off base) give ``delta`` from the
    base value and ``delta / (level - base level)`` per unit. Levers are
    ranked per output by the mean absolute per-unit delta (unrounded).
    ``base_values`` maps output -> base value; ``None`` looks the base cell
    up in each grid.
    """
    keys = list(keys)
    rows = None
    for g in grids:
        r = _lever_rows(g, keys, base_values)
        rows = r if rows is None else rows.unionByName(r)
    agg = rows.groupBy(*keys, "lever", "output").agg(
        F.avg(F.abs("delta_per_unit")).alias("avg_abs"),
        F.min("delta").alias("worst"),
        F.max("delta").alias("best"),
        F.count(F.lit(1)).alias("data_points"),
    )
    w = Window.partitionBy(*keys, "output").orderBy(F.desc_nulls_last("avg_abs"))
    coarse = list(coarse_outputs)
    return agg.select(
        *keys,
        "lever",
        "output",
        round_by_output("avg_abs", "output", coarse).alias("avg_sensitivity_per_unit"),
        round_by_output("worst", "output", coarse).alias("worst_case_delta"),
        round_by_output("best", "output", coarse).alias("best_case_delta"),
        "data_points",
        F.rank().over(w).cast("bigint").alias("impact_rank"),
    )


def interaction_effects(
    grid: DataFrame,
    keys: Iterable[str] = (),
    origin: tuple[float, float] = (0.0, 0.0),
    coarse_outputs: Iterable[str] = (S.OUT_REVENUE,),
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Interaction of two growth levers: f(x, y) - [f(x, 0) + f(0, y) - f(0, 0)].

    Reported for interior cells (both levers above the origin level) that
    have their zero-row, zero-column and origin cells; ``interaction_pct_of_actual``
    is the residual as % of the actual value. The three reference cells are
    windowed maxima (over (keys, output, x), (keys, output, y) and (keys, output))
    on the partitioning by keys: no self-joins.
    """
    keys = list(keys)
    ox, oy = _axis(origin[0]), _axis(origin[1])
    xs, ys, v = F.col(x), F.col(y), F.col("value")
    part = [*keys, "output"]
    g = _by_keys(grid.select(*keys, "output", x, y, "value"), keys)
    on_row, on_col, at_origin = ys == oy, xs == ox, (xs == ox) & (ys == oy)
    w_x, w_y, w_o = Window.partitionBy(*part, x), Window.partitionBy(*part, y), Window.partitionBy(*part)
    g = g.select(
        *part,
        x,
        y,
        "value",
        F.max(F.when(on_row, v)).over(w_x).alias("x_only"),
        F.count(F.when(on_row, F.lit(1))).over(w_x).alias("n_x_only"),
        F.max(F.when(on_col, v)).over(w_y).alias("y_only"),
        F.count(F.when(on_col, F.lit(1))).over(w_y).alias("n_y_only"),
        F.max(F.when(at_origin, v)).over(w_o).alias("origin_value"),
        F.count(F.when(at_origin, F.lit(1))).over(w_o).alias("n_origin"),
    ).where(
        (xs > ox) & (ys > oy) & (F.col("n_x_only") > 0) & (F.col("n_y_only") > 0) & (F.col("n_origin") > 0)
    )
    additive = F.col("x_only") + F.col("y_only") - F.col("origin_value")
    inter = F.col("value") - additive
    coarse = list(coarse_outputs)
    return g.select(
        *keys,
        xs.cast("double").alias(x),
        ys.cast("double").alias(y),
        "output",
        round_by_output("value", "output", coarse).alias("actual"),
        round_by_output(additive, "output", coarse).alias("additive_expected"),
        round_by_output(inter, "output", coarse).alias("interaction_effect"),
        F.round(safe_div(inter, "value") * F.lit(100.0), 4).alias("interaction_pct_of_actual"),
    )
