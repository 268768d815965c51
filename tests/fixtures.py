"""Closed-form planning model used as a test fixture.

For month m = 1..12 (k = m - 1) and each scenario:

    fleet      = F0 (1 + gf)^k            rides    = fleet * rpv
    revenue    = rides * r0 * [(1 - w) + w * s * (1 + gp)^k]   (s = price scale, 1 by default)
    variable   = rides * v0 (1 + gi)^k    CM       = revenue - variable
    vehicle    = fleet * vf (1 + gi)^k    platform = po (1 + gi)^k
    EBITDA     = CM - (vehicle + platform); margins are fractions of revenue

Yearly totals are sums (ratios of sums for margins, month-12 fleet). The
parameters are calibrated so the model reproduces the published findings of
the planning analyses (crossover month, leverage path, payback months ...).
Sensitivity grids rerun the Base scenario for a year with fixed inflation 0.
"""

from __future__ import annotations

import itertools

import pandas as pd

from scenaria import schema as S

# Calibrated scenario parameters.
PARAMS = {
    "Base": dict(F0=500, gf=0.03, rpv=957, r0=7.01, w=0.87, gp=0.01, v0=2.13, gi=0.015, vf=447.0, po=24800),
    "High": dict(F0=700, gf=0.05, rpv=1090, r0=12.90, w=0.89, gp=0.02, v0=2.32, gi=0.008, vf=355.0, po=25000),
    "Low": dict(F0=350, gf=0.01, rpv=784.4, r0=3.42, w=0.0, gp=0.0, v0=2.305, gi=0.025, vf=528.5, po=25000),
}
GRID_BASE = dict(F0=500, gf=0.03, rpv=957, r0=7.01, w=0.87, gp=0.01, v0=1.97, gi=0.0, vf=600.0, po=24800)
PRICES = (0.21, 0.25, 0.29, 0.33, 0.37)
UTILS = (0.50, 0.575, 0.65, 0.725, 0.80)
FLEET_GROWTHS = (0.0, 0.015, 0.03, 0.045, 0.06)
PRICE_GROWTHS = (0.0, 0.005, 0.01, 0.015, 0.02)


def month_metrics(p: dict, m: int) -> dict:
    k = m - 1
    fleet = p["F0"] * (1 + p["gf"]) ** k
    rides = fleet * p["rpv"]
    revenue = rides * p["r0"] * ((1 - p["w"]) + p["w"] * p.get("price_scale", 1.0) * (1 + p["gp"]) ** k)
    variable = rides * p["v0"] * (1 + p["gi"]) ** k
    cm = revenue - variable
    vehicle = fleet * p["vf"] * (1 + p["gi"]) ** k
    platform = p["po"] * (1 + p["gi"]) ** k
    fixed = vehicle + platform
    ebitda = cm - fixed
    return {
        S.FLEET: fleet,
        S.RIDES: rides,
        S.REVENUE: revenue,
        S.VARIABLE_COSTS: variable,
        S.CONTRIBUTION_MARGIN: cm,
        S.CM_PCT: cm / revenue,
        S.VEHICLE_FIXED: vehicle,
        S.PLATFORM_OVERHEAD: platform,
        S.TOTAL_FIXED: fixed,
        S.EBITDA: ebitda,
        S.EBITDA_PCT: ebitda / revenue,
    }


def fact_pdf(entities=(None,), months: int = 12, params: dict = PARAMS) -> pd.DataFrame:
    rows = []
    for e, (sc, p) in itertools.product(entities, params.items()):
        for m in range(1, months + 1):
            for metric, v in month_metrics(p, m).items():
                r = {"scenario": sc, "month_number": m, "month": f"Month_{m}", "metric": metric, "value": float(v)}
                if e is not None:
                    r = {"entity": e, **r}
                rows.append(r)
    return pd.DataFrame(rows)


def totals_pdf(entities=(None,), params: dict = PARAMS) -> pd.DataFrame:
    rows = []
    for e, (sc, p) in itertools.product(entities, params.items()):
        ms = [month_metrics(p, m) for m in range(1, 13)]
        tot = {k: sum(x[k] for x in ms) for k in ms[0]}
        tot[S.FLEET] = ms[-1][S.FLEET]
        tot[S.CM_PCT] = tot[S.CONTRIBUTION_MARGIN] / tot[S.REVENUE]
        tot[S.EBITDA_PCT] = tot[S.EBITDA] / tot[S.REVENUE]
        for metric, v in tot.items():
            r = {"scenario": sc, "metric": metric, "fy_total": float(v)}
            if e is not None:
                r = {"entity": e, **r}
            rows.append(r)
    return pd.DataFrame(rows)


def _fy(p: dict) -> tuple[float, float]:
    ms = [month_metrics(p, m) for m in range(1, 13)]
    rev = sum(x[S.REVENUE] for x in ms)
    ebitda = sum(x[S.EBITDA] for x in ms)
    return rev, ebitda / rev


def price_util_pdf() -> pd.DataFrame:
    rows = []
    for price, util in itertools.product(PRICES, UTILS):
        # price scales the price-indexed part of revenue per ride; utilisation scales rides
        p = dict(GRID_BASE, price_scale=price / 0.29, rpv=GRID_BASE["rpv"] * util / 0.65)
        rev, margin = _fy(p)
        rows.append(("1A", S.OUT_REVENUE, price, util, rev))
        rows.append(("1B", S.OUT_MARGIN, price, util, margin))
    return pd.DataFrame(rows, columns=["table", "output", "x", "y", "value"])


def growth_pdf() -> pd.DataFrame:
    rows = []
    for gf, gp in itertools.product(FLEET_GROWTHS, PRICE_GROWTHS):
        rev, margin = _fy(dict(GRID_BASE, gf=gf, gp=gp))
        rows.append(("2A", S.OUT_REVENUE, gf, gp, rev))
        rows.append(("2B", S.OUT_MARGIN, gf, gp, margin))
    return pd.DataFrame(rows, columns=["table", "output", "x", "y", "value"])


def to_grid(spark, pdf: pd.DataFrame, keys: dict | None = None):
    """pandas grid -> Spark grid with decimal axes (optionally replicated per entity)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    df = df.select(
        "table",
        "output",
        F.col("x").cast("string").cast(S.AXIS).alias("x"),
        F.col("y").cast("string").cast(S.AXIS).alias("y"),
        "value",
    )
    return df
