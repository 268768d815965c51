"""Missing periods and missing cells; tables that are read without an exchange."""

import os
import uuid

import fixtures as fx
import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria import schema as S
from scenaria.operators import audit as au
from scenaria.operators import timeseries as ts
from scenaria.sources import sinks

SF_DIR = os.environ.get("SCENARIA_TEST_SF", "/root/testdata/sf0.001")
FACT = "entity string, scenario string, month_number int, metric string, value double"


def series(values, entity="a"):
    return [(entity, "Base", m, S.EBITDA, v) for m, v in values.items()]


def test_crossings_interpolate_over_the_gap(spark):
    fact = spark.createDataFrame(series({1: -30.0, 4: 60.0, 5: -60.0, 9: None, 10: 5.0}) + series({2: -1.0, 3: 1.0}, "b"), FACT)
    got = {(r["entity"], r["crossing_month"]): r["interpolated_zero_month"] for r in ts.zero_crossings(fact, keys=["entity"], over_gaps=True).collect()}
    assert got == {("a", 4): 2.0, ("a", 5): 4.5, ("b", 3): 2.5}
    before = {(r["entity"], r["crossing_month"]): r["interpolated_zero_month"] for r in ts.zero_crossings(fact, keys=["entity"]).collect()}
    assert before == {("a", 4): 3.33, ("a", 5): 4.5, ("b", 3): 2.5}


def test_gaps_are_filled_by_distance(spark):
    data = series({2: 10.0, 3: 20.0, 7: 60.0, 8: None, 10: 1.0}) + series({5: 1.0}, None)
    got = rows(ts.fill_gaps(spark.createDataFrame(data, FACT), keys=["entity"]).where("entity IS NOT NULL"), "month_number")
    assert [(r["month_number"], r["value"], r["filled"]) for r in got] == [
        (2, 10.0, False), (3, 20.0, False), (4, 30.0, True), (5, 40.0, True), (6, 50.0, True), (7, 60.0, False), (8, None, False), (9, None, True), (10, 1.0, False)
    ]
    assert [r["month"] for r in got][:2] == ["Month_2", "Month_3"]
    assert ts.fill_gaps(spark.createDataFrame(data, FACT), keys=["entity"]).where("entity IS NULL").count() == 1


def test_a_series_without_gaps_is_left_alone(spark, fact):
    keep = ["scenario", "metric", "month_number", "month", "value"]
    filled = ts.fill_gaps(fact)
    assert not filled.where("filled").take(1)
    assert rows(filled.select(*keep), *keep[:3]) == rows(fact.select(*keep), *keep[:3])


def test_missing_and_doubled_cells_are_listed(spark, price_util):
    """One cell away and another twice: the count alone still fits."""
    one = (F.col("x") == "0.2500") & (F.col("y") == "0.5000") & (F.col("output") == S.OUT_REVENUE)
    two = (F.col("x") == "0.3300") & (F.col("y") == "0.8000") & (F.col("output") == S.OUT_MARGIN)
    broken = price_util.where(~one).unionByName(price_util.where(two))
    assert broken.count() == price_util.count() == 50
    got = sorted((float(r["x"]), float(r["y"]), r["output"], r["n_rows"], r["finding"]) for r in au.grid_cells_check(broken).collect())
    assert got == [(0.25, 0.5, S.OUT_REVENUE, 0, "MISSING"), (0.33, 0.8, S.OUT_MARGIN, 2, "DOUBLED")]
    assert au.grid_cells_check(price_util).collect() == []


def test_cells_are_checked_by_key(spark):
    rows_ = [("a", 1, 1, 5.0), ("a", 2, 1, None), ("a", 2, 2, 1.0), ("b", 9, 9, 1.0), (None, 1, 1, 1.0), (None, 2, 2, 1.0), ("", 1, 1, 1.0)]
    grid = spark.createDataFrame(rows_, "k string, x int, y int, value double").withColumn("output", F.lit("o"))
    got = sorted((str(r["k"]), r["x"], r["y"], r["finding"]) for r in au.grid_cells_check(grid, ["k"]).collect())
    assert got == [("None", 1, 2, "MISSING"), ("None", 2, 1, "MISSING"), ("a", 1, 2, "MISSING"), ("a", 2, 1, "NULL VALUE")]


def test_a_changed_assumption_fails_on_the_given_tables(spark):
    from scenaria.plans.catalog import QUERIES

    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    got = QUERIES["replanned_vs_totals"](spark, SF_DIR).collect()
    status = {(r["assumption"], r["output"], r["status"]) for r in got}
    changed = "vehicles at 1.1 times the cost"
    assert status == {
        ("as planned", S.OUT_REVENUE, "PASS"), ("as planned", S.OUT_MARGIN, "PASS"), (changed, S.OUT_REVENUE, "PASS"), (changed, S.OUT_MARGIN, "FAIL")
    }


@pytest.fixture
def bucketed(spark, tmp_path):
    name = f"fact_{uuid.uuid4().hex}"
    df = spark.createDataFrame(fx.fact_pdf(entities=["a", "b", "c"]))
    return sinks.write_bucketed(df, name, str(tmp_path / "fact"), ["entity"], 4, ["month_number"]), df, str(tmp_path / "fact")


def test_a_pivot_of_a_bucketed_table_shows_no_exchange(spark, bucketed):
    table, df, path = bucketed
    again = sinks.open_bucketed(spark, f"fact_{uuid.uuid4().hex}", path, ["entity"], 4, ["month_number"])
    order = ["entity", "scenario", "month"]
    for t in (table, again):
        report = au.reconcile(t, keys=["entity"])
        assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()
        assert rows(report, *order) == rows(au.reconcile(df, keys=["entity"]), *order)
