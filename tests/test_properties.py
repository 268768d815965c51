"""Property tests (random consistent P&Ls, several entities): identities that must hold."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from result_rows import rows

from scenaria import schema as S
from scenaria.operators import audit as au
from scenaria.operators import portfolio as pf
from scenaria.operators import timeseries as ts

money = st.integers(min_value=1, max_value=10**8).map(lambda c: c / 100.0)


@st.composite
def pnl(draw):
    """A random but internally consistent long fact for a few entities and scenarios."""
    n_ent = draw(st.integers(1, 3))
    months = draw(st.integers(2, 6))
    recs = []
    for e in range(n_ent):
        for sc in ("Low", "Base", "High"):
            for m in range(1, months + 1):
                rides = float(draw(st.integers(1, 10**6)))
                rev, var, veh, plat = draw(money), draw(money), draw(money), draw(money)
                fleet = float(draw(st.integers(1, 1000)))
                cm, fixed = rev - var, veh + plat
                ebitda = cm - fixed
                vals = {
                    S.FLEET: fleet, S.RIDES: rides, S.REVENUE: rev, S.VARIABLE_COSTS: var,
                    S.CONTRIBUTION_MARGIN: cm, S.CM_PCT: cm / rev, S.VEHICLE_FIXED: veh,
                    S.PLATFORM_OVERHEAD: plat, S.TOTAL_FIXED: fixed, S.EBITDA: ebitda, S.EBITDA_PCT: ebitda / rev,
                }
                for k, v in vals.items():
                    recs.append((f"e{e}", sc, m, f"Month_{m}", k, v))
    return pd.DataFrame(recs, columns=["entity", "scenario", "month_number", "month", "metric", "value"])


SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(pdf=pnl())
def test_identities_hold_on_random_pnls(spark, pdf):
    fact = spark.createDataFrame(pdf).cache()
    keys = ["entity"]
    # volume + price + mix = revenue change
    for r in rows(ts.volume_price_mix(fact, keys=keys)):
        parts = r["volume_effect"] + r["price_effect"] + r["mix_effect"]
        assert parts == pytest.approx(r["total_rev_change"], abs=0.03 + 1e-9 * abs(r["total_rev_change"]))
    # the running spread ends at the sum of the spreads
    sp = rows(ts.scenario_spread(fact, keys=keys), "entity", "metric", "month")
    last = {}
    total = {}
    for r in sp:
        k = (r["entity"], r["metric"])
        total[k] = total.get(k, 0.0) + r["spread_high_low"]
        last[k] = r["cumulative_spread"]
    for k in last:
        assert last[k] == pytest.approx(total[k], abs=0.01 * len(sp))
    # a consistent P&L reconciles
    assert {r["integrity_status"] for r in rows(au.reconcile(fact, keys=keys))} == {"PASS"}
    # all weight on one scenario reproduces it
    for r in rows(pf.weighted_expectation(fact, {"Base": 1.0}, keys=keys)):
        assert r["expected_ebitda"] == r["base_ebitda"]
    # one row per (entity, scenario, month) for the per-period analyses
    n = pdf[["entity", "scenario", "month_number"]].drop_duplicates().shape[0]
    assert ts.margin_of_safety(fact, keys=keys).count() == n
    assert ts.unit_economics(fact, keys=keys).count() == n
    fact.unpersist()


@SETTINGS
@given(pdf=pnl())
def test_entities_are_independent(spark, pdf):
    """Analysing all entities at once equals analysing each alone."""
    fact = spark.createDataFrame(pdf)
    together = rows(ts.operating_leverage(fact, keys=["entity"]), "entity", "scenario", "month")
    for e in sorted(pdf["entity"].unique()):
        alone = rows(ts.operating_leverage(spark.createDataFrame(pdf[pdf.entity == e].drop(columns="entity"))),
                     "scenario", "month")
        mine = [{k: v for k, v in r.items() if k != "entity"} for r in together if r["entity"] == e]
        assert mine == alone


@st.composite
def linear_grid(draw):
    a = draw(st.integers(-500, 500)) / 10.0
    b = draw(st.integers(-500, 500)) / 10.0
    c = draw(st.integers(0, 10**6)) / 10.0
    nx, ny = draw(st.integers(2, 5)), draw(st.integers(2, 5))
    xs = sorted(draw(st.lists(st.integers(0, 400), min_size=nx, max_size=nx, unique=True)))
    ys = sorted(draw(st.lists(st.integers(0, 400), min_size=ny, max_size=ny, unique=True)))
    recs = []
    for out, scale in ((S.OUT_MARGIN, 1.0), (S.OUT_REVENUE, 1000.0)):
        for x in xs:
            for y in ys:
                recs.append((out, f"{x / 100:.2f}", f"{y / 100:.2f}", scale * (a * x / 100 + b * y / 100 + c)))
    return a, b, pd.DataFrame(recs, columns=["output", "x", "y", "value"])


@SETTINGS
@given(g=linear_grid())
def test_linear_grid_slopes_and_no_interaction(spark, g):
    from pyspark.sql import functions as F

    from scenaria.operators import grid as gr

    a, b, pdf = g
    grid = spark.createDataFrame(pdf).select(
        "output", F.col("x").cast(S.AXIS).alias("x"), F.col("y").cast(S.AXIS).alias("y"), "value"
    )
    for r in rows(gr.grid_sensitivity(grid)):
        if r["dmargin_dx"] is not None:
            assert r["dmargin_dx"] == pytest.approx(a, abs=1e-3)
            assert r["drevenue_dx"] == pytest.approx(1000 * a, abs=1.0)
        if r["dmargin_dy"] is not None:
            assert r["dmargin_dy"] == pytest.approx(b, abs=1e-3)
    # shift the origin to the grid's first levels so the interior is every other cell
    x0, y0 = float(pdf["x"].min()), float(pdf["y"].min())
    inter = rows(gr.interaction_effects(grid, origin=(x0, y0)))
    nx, ny = pdf["x"].nunique(), pdf["y"].nunique()
    assert len(inter) == 2 * (nx - 1) * (ny - 1)
    assert all(abs(r["interaction_effect"]) <= 1e-3 * max(1.0, abs(r["actual"])) for r in inter)
