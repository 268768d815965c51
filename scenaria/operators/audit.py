"""Governance checks: accounting reconciliation, grid completeness, load counts, uniqueness.

Each check is a distributed aggregate; only the (small) report rows exist
at the end, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.functions import safe_div
from scenaria.operators.pivot import pivot_metrics

PERIOD = "month_number"


def reconcile(
    fact: DataFrame,
    tol_abs: float = 0.01,
    tol_pct: float = 0.001,
    strict: bool = False,
    keys: Iterable[str] = (),
) -> DataFrame:
    """Five accounting identities per (keys, scenario, period) with a composite status.

    1 revenue - variable = contribution margin; 2 contribution margin - total
    fixed = EBITDA; 3 vehicle fixed + platform = total fixed; 4 CM % = CM /
    revenue; 5 EBITDA % = EBITDA / revenue. Money variances are rounded to 2
    digits and ratios to 6 before the tolerance test. A missing metric makes
    its variance NULL, which does not fail the test (``PASS``); with
    ``strict=True`` such rows report ``INCOMPLETE``.
    """
    keys = list(keys)
    p = pivot_metrics(
        fact,
        {
            S.REVENUE: "revenue",
            S.VARIABLE_COSTS: "variable_costs",
            S.CONTRIBUTION_MARGIN: "contribution_margin",
            S.CM_PCT: "cm_pct",
            S.TOTAL_FIXED: "total_fixed",
            S.VEHICLE_FIXED: "vehicle_fixed",
            S.PLATFORM_OVERHEAD: "platform_overhead",
            S.EBITDA: "ebitda",
            S.EBITDA_PCT: "ebitda_pct",
        },
        [*keys, "scenario", PERIOD],
    )
    c = F.col
    money = {
        "cm_variance": F.round(F.abs((c("revenue") - c("variable_costs")) - c("contribution_margin")), 2),
        "ebitda_variance": F.round(F.abs((c("contribution_margin") - c("total_fixed")) - c("ebitda")), 2),
        "fixed_variance": F.round(F.abs((c("vehicle_fixed") + c("platform_overhead")) - c("total_fixed")), 2),
    }
    ratios = {
        "cm_pct_variance": F.round(F.abs(safe_div("contribution_margin", "revenue") - c("cm_pct")), 6),
        "ebitda_pct_variance": F.round(F.abs(safe_div("ebitda", "revenue") - c("ebitda_pct")), 6),
    }
    fail = None
    for e in money.values():
        t = e > F.lit(float(tol_abs))
        fail = t if fail is None else fail | t
    for e in ratios.values():
        fail = fail | (e > F.lit(float(tol_pct)))
    status = F.when(fail, F.lit("FAIL"))
    if strict:
        missing = None
        for e in [*money.values(), *ratios.values()]:
            missing = e.isNull() if missing is None else missing | e.isNull()
        status = status.when(missing, F.lit("INCOMPLETE"))
    # one projection: the status reuses the variance expressions (common
    # subexpressions are evaluated once in generated code)
    return p.select(
        *keys,
        "scenario",
        c(PERIOD).alias("month"),
        *[e.alias(n) for n, e in {**money, **ratios}.items()],
        status.otherwise(F.lit("PASS")).alias("integrity_status"),
    )


@dataclass(frozen=True)
class AuditGrid:
    """A grid to audit: its report name, data, axis columns and base cell."""

    name: str
    grid: DataFrame
    base_x: float | None = None
    base_y: float | None = None
    x: str = "x"
    y: str = "y"


REPORT = (
    ("audit_check", "string"),
    ("table_name", "string"),
    ("total_rows", "double"),
    ("expected_rows", "double"),
    ("grid_shape", "string"),
    ("null_values", "double"),
    ("status", "string"),
)


def _report(keep: Column, *cols: Column) -> Column:
    fields = [c.cast(t).alias(n) for c, (n, t) in zip(cols, REPORT, strict=True)]
    return F.when(keep, F.struct(*fields))


def grid_audit(
    grids: Sequence[AuditGrid],
    cross_check: tuple[int, int] | None = (0, 1),
    keys: Iterable[str] = (),
    strict: bool = False,
    outputs: Sequence[str] = (S.OUT_REVENUE, S.OUT_MARGIN),
) -> DataFrame:
    """Grid shape, duplicate and cross-grid base-cell audit.

    * ``1_GRID_COMPLETENESS``: rows vs product of distinct levels of both axes
      and outputs, shape ``"a x b x o"``, NULL values; PASS when rows equal the
      product and there are no NULLs (an empty grid has NULL nulls -> FAIL).
    * ``2_DUPLICATE_CHECK``: number of (x, y, output) groups with more than one row.
    * ``3_BASE_CASE_CROSS_CHECK``: per output of ``outputs``, |base cell of grid i - base
      cell of grid j| rounded to 4 digits; PASS when 0. A missing base cell yields no
      row; ``strict=True`` gives a FAIL row instead, also when both are missing.

    All grids are audited in one pass: they are tagged and unioned, counted per
    cell, and summed up in one aggregate per key combination with conditional
    measures per grid (so a key that one grid lacks is reported for that grid
    too, and without keys an empty grid has its rows). Two exchanges in all.
    """
    keys = list(keys)
    tagged = None
    for i, g in enumerate(grids):
        x, y = F.col(g.x), F.col(g.y)
        at_base = F.lit(False)
        if g.base_x is not None and g.base_y is not None:
            at_base = (x == F.lit(str(g.base_x)).cast(S.AXIS)) & (y == F.lit(str(g.base_y)).cast(S.AXIS))
        t = g.grid.select(
            F.lit(i).alias("g"), *keys, x.alias("gx"), y.alias("gy"), "output", "value", F.coalesce(at_base, F.lit(False)).alias("at_base")
        )
        tagged = t if tagged is None else tagged.unionByName(t)
    cells = tagged.groupBy("g", *keys, "gx", "gy", "output").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("value").isNull(), F.lit(1))).alias("nulls"),
        F.max("value").alias("value"),
        F.max("at_base").alias("at_base"),
    )

    def of(i: int, c) -> Column:
        return F.when(F.col("g") == i, F.col(c) if isinstance(c, str) else c)

    measures = []
    for i in range(len(grids)):
        measures += [
            F.coalesce(F.sum(of(i, "n")), F.lit(0)).alias(f"rows{i}"),
            F.sum(of(i, "nulls")).alias(f"nulls{i}"),
            F.count(of(i, F.when(F.col("n") > 1, F.lit(1)))).alias(f"dups{i}"),
            # distinct levels of an axis: as many as the grid has rows or columns
            *[F.size(F.collect_set(of(i, c))).alias(f"{c}{i}") for c in ("gx", "gy", "output")],
        ]
    pair = tuple(cross_check or ())
    for i in pair:
        for o, output in enumerate(outputs):
            here = F.col("at_base") & (F.col("output") == output)
            measures += [
                F.max(of(i, F.when(here, F.col("value")))).alias(f"base{i}_{o}"),
                F.count(of(i, F.when(here, F.lit(1)))).alias(f"has{i}_{o}"),
            ]
    summary = cells.groupBy(*keys).agg(*measures)
    always, none = F.lit(True), F.lit(None)
    rows = []
    for i, g in enumerate(grids):
        n, nulls, dups = F.col(f"rows{i}"), F.col(f"nulls{i}"), F.col(f"dups{i}")
        shape = [F.col(f"{c}{i}") for c in ("gx", "gy", "output")]
        expected = shape[0] * shape[1] * shape[2]
        complete = (n == expected) & (nulls == 0)
        text = F.concat_ws(" x ", *[c.cast("string") for c in shape])
        name = F.lit(g.name)
        passed = lambda ok: F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))
        rows.append(_report(always, F.lit("1_GRID_COMPLETENESS"), name, n, expected, text, nulls, passed(complete)))
        rows.append(_report(always, F.lit("2_DUPLICATE_CHECK"), name, dups, F.lit(0), none, none, passed(dups == 0)))
    if pair:
        a, b = pair
        for o, output in enumerate(outputs):
            va, vb = F.col(f"base{a}_{o}"), F.col(f"base{b}_{o}")
            both = (F.col(f"has{a}_{o}") > 0) & (F.col(f"has{b}_{o}") > 0)
            var = F.round(F.abs(va - vb), 4)
            keep = always if strict else both
            rows.append(_report(keep, F.lit("3_BASE_CASE_CROSS_CHECK"), F.lit(output), va, vb, none, var, passed(both & (var == 0))))
    return summary.select(*keys, F.explode(F.array(*rows)).alias("r")).where("r IS NOT NULL").select(*keys, "r.*")


def grid_cells_check(grid: DataFrame, keys: Iterable[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """The cells that make a grid incomplete: ``(keys..., x, y, output, n_rows, finding)``.

    ``MISSING``: a position of the lattice of a key's own levels and outputs that has no row; ``DOUBLED``:
    more than one; ``NULL VALUE``: one without a value. Counts alone cannot tell: a missing and a doubled
    cell add up to the expected number of rows. The lattice grows with the levels of x, each of which meets
    its key's levels of y and outputs; keys may be NULL.
    """
    keys = list(keys)
    cells = grid.groupBy(*keys, x, y, "output").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))
    match = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + [F.col(k).isNull().cast("string") for k in keys]
    named = cells.withColumn("_key", F.array(F.lit(""), *match))
    levels = named.groupBy("_key").agg(F.collect_set(y).alias("_ys"), F.collect_set("output").alias("_outputs"))
    lattice = named.select("_key", *keys, x).distinct().join(levels, "_key")
    lattice = lattice.select("_key", *keys, x, F.explode("_ys").alias(y), "_outputs").select("_key", *keys, x, y, F.explode("_outputs").alias("output"))
    missing = lattice.join(named.select("_key", x, y, "output"), ["_key", x, y, "output"], "left_anti").select(
        *keys, x, y, "output", F.lit(0).cast("long").alias("n_rows"), F.lit("MISSING").alias("finding")
    )
    found = F.when(F.col("n_rows") > 1, "DOUBLED").when(F.col("n_values") == 0, "NULL VALUE")
    wrong = cells.withColumn("finding", found).where("finding IS NOT NULL").select(*keys, x, y, "output", "n_rows", "finding")
    return missing.unionByName(wrong)


def grid_vs_totals_check(
    grid: DataFrame,
    totals: DataFrame,
    base_x: float,
    base_y: float,
    outputs: Mapping[str, str] | None = None,
    scenario: str = "Base",
    tol: float = 1e-6,
    keys: Iterable[str] = (),
    tags: Iterable[str] = (),
) -> DataFrame:
    """Compare a grid's base cell with the yearly totals of the base scenario.

    ``outputs`` maps grid output -> totals metric (default: revenue and EBITDA
    margin). The grid-only cross-check cannot see a grid that was computed
    with different assumptions than the P&L; this one can. Report per output:
    grid value, totals value, relative variance and PASS / FAIL. ``tags`` are
    columns of the grid alone that tell several grids of one plan apart.
    """
    keys, tags = list(keys), list(tags)
    outputs = dict(outputs or {S.OUT_REVENUE: S.REVENUE, S.OUT_MARGIN: S.EBITDA_PCT})
    cond = (F.col("x") == F.lit(str(base_x)).cast(S.AXIS)) & (F.col("y") == F.lit(str(base_y)).cast(S.AXIS))
    g = grid.where(cond & F.col("output").isin(list(outputs))).select(
        *keys, *tags, "output", F.col("value").alias("grid_value")
    )
    metric_of = F.create_map(*[F.lit(v) for kv in outputs.items() for v in kv])
    t = totals.where((F.col("scenario") == scenario) & F.col("metric").isin(list(outputs.values())))
    j = g.withColumn("metric", F.element_at(metric_of, F.col("output"))).join(
        t.select(*keys, "metric", F.col("fy_total").alias("totals_value")), [*keys, "metric"]
    )
    rel = F.abs(F.col("grid_value") - F.col("totals_value")) / F.greatest(F.abs(F.col("totals_value")), F.lit(1e-12))
    return j.select(
        *keys,
        *tags,
        "output",
        "grid_value",
        "totals_value",
        F.round(rel, 6).alias("relative_variance"),
        F.when(rel <= F.lit(tol), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def load_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every loaded table: ``(table_name, n_rows)``; one distributed count each."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_unique(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Key groups that occur more than once: ``(keys..., n)``. Empty when ``keys`` is a key."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
