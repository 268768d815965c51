"""Grid operators against the closed-form grids."""

import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria import schema as S
from scenaria.operators import grid as gr


def test_grid_sensitivity_golden(price_util):
    rs = rows(gr.grid_sensitivity(price_util, step_x=0.04, step_y=0.075), "x", "y")
    assert len(rs) == 25
    assert sum(r["dominant_margin_lever"] == "Price" for r in rs) == 20
    at = {(r["x"], r["y"]): r for r in rs}
    assert at[(0.25, 0.5)]["dmargin_dx"] == pytest.approx(1.75, abs=0.006)
    assert at[(0.37, 0.5)]["dmargin_dx"] == pytest.approx(0.84, abs=0.006)
    # first level of an axis has no backward difference
    assert at[(0.21, 0.65)]["dmargin_dx"] is None and at[(0.21, 0.65)]["lever_comparable"] is False
    assert sum(r["lever_comparable"] for r in rs) == 16
    assert at[(0.29, 0.65)]["net_revenue"] == pytest.approx(50112793, abs=1)
    assert at[(0.29, 0.65)]["ebitda_margin_pct"] == pytest.approx(64.21, abs=0.01)


def test_grid_sensitivity_needs_both_outputs(price_util):
    one_missing = price_util.where(~((F.col("output") == S.OUT_REVENUE) & (F.col("x") == 0.29) & (F.col("y") == 0.65)))
    assert gr.grid_sensitivity(one_missing).count() == 24


def test_lever_ranking_golden(price_util, growth):
    grids = [
        gr.GridLevers(price_util, "Price_Per_Min", "Util_Rate", 0.29, 0.65),
        gr.GridLevers(growth, "Fleet_Growth", "Price_Growth", 0.03, 0.01),
    ]
    rs = rows(gr.lever_ranking(grids), "output", "impact_rank")
    assert len(rs) == 8
    rev = [r for r in rs if r["output"] == S.OUT_REVENUE]
    assert [r["lever"] for r in rev] == ["Fleet_Growth", "Price_Growth", "Price_Per_Min", "Util_Rate"]
    expect = {"Fleet_Growth": 290.9e6, "Price_Growth": 259.7e6, "Price_Per_Min": 151.5e6, "Util_Rate": 77.1e6}
    for r in rev:
        assert r["avg_sensitivity_per_unit"] == pytest.approx(expect[r["lever"]], rel=2e-3)
        assert r["data_points"] == 4
    mar = [r for r in rs if r["output"] == S.OUT_MARGIN]
    assert [r["lever"] for r in mar] == ["Price_Growth", "Price_Per_Min", "Util_Rate", "Fleet_Growth"]
    expect = {"Price_Growth": 1.854, "Price_Per_Min": 1.123, "Util_Rate": 0.145, "Fleet_Growth": 0.070}
    for r in mar:
        assert r["avg_sensitivity_per_unit"] == pytest.approx(expect[r["lever"]], abs=0.0015)
    assert sorted(r["impact_rank"] for r in mar) == [1, 2, 3, 4]


def test_lever_ranking_literal_base_values(price_util, growth):
    grids = [gr.GridLevers(price_util, "P", "U", 0.29, 0.65), gr.GridLevers(growth, "F", "G", 0.03, 0.01)]
    looked_up = rows(gr.lever_ranking(grids), "output", "lever")
    base = {S.OUT_REVENUE: 50112793.448146, S.OUT_MARGIN: 0.642142}
    literal = rows(gr.lever_ranking(grids, base_values=base), "output", "lever")
    assert [r["impact_rank"] for r in literal] == [r["impact_rank"] for r in looked_up]


def test_rank_ties(spark):
    g = spark.createDataFrame(
        [("o", x, y, v) for x, y, v in [("0", "0", 0.0), ("1", "0", 1.0), ("0", "1", 1.0)]],
        "output string, x string, y string, value double",
    ).select("output", F.col("x").cast(S.AXIS).alias("x"), F.col("y").cast(S.AXIS).alias("y"), "value")
    rs = rows(gr.lever_ranking([gr.GridLevers(g, "X", "Y", 0, 0)]), "lever")
    assert [r["impact_rank"] for r in rs] == [1, 1]


def test_interaction_effects_golden(growth):
    rs = rows(gr.interaction_effects(growth), "output", "x", "y")
    assert len(rs) == 32
    r = [r for r in rs if r["output"] == S.OUT_REVENUE and r["x"] == 0.06 and r["y"] == 0.02][0]
    assert r["interaction_effect"] == pytest.approx(2424097, abs=1)
    assert r["interaction_pct_of_actual"] == pytest.approx(3.84, abs=0.005)


def test_interaction_is_zero_on_additive_grid(spark):
    data = [("o", f"{x}", f"{y}", 3.0 * x + 5.0 * y + 1.0) for x in range(4) for y in range(3)]
    g = spark.createDataFrame(data, "output string, x string, y string, value double").select(
        "output", F.col("x").cast(S.AXIS).alias("x"), F.col("y").cast(S.AXIS).alias("y"), "value"
    )
    rs = rows(gr.interaction_effects(g))
    assert len(rs) == 3 * 2
    assert all(r["interaction_effect"] == 0 for r in rs)


def test_interaction_needs_origin(growth):
    no_origin = growth.where(~((F.col("x") == 0) & (F.col("y") == 0)))
    assert gr.interaction_effects(no_origin).count() == 0


def test_grid_keys_match_single_entity(spark, growth, price_util):
    many = growth.select(F.explode(F.array(*[F.lit(f"e{i}") for i in range(5)])).alias("entity"), "*")
    single = rows(gr.interaction_effects(growth), "output", "x", "y")
    multi = gr.interaction_effects(many, keys=["entity"])
    assert multi.count() == 5 * 32
    assert rows(multi.where("entity = 'e2'").drop("entity"), "output", "x", "y") == single
    pu_many = price_util.select(F.explode(F.array(*[F.lit(f"e{i}") for i in range(3)])).alias("entity"), "*")
    s1 = rows(gr.grid_sensitivity(price_util), "x", "y")
    m1 = rows(gr.grid_sensitivity(pu_many, keys=["entity"]).where("entity = 'e1'").drop("entity"), "x", "y")
    assert s1 == m1
