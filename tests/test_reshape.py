"""Reshape / load steps on sheet-shaped inputs."""

import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria.sources import reshape as rs

SHEET = "sheet string, row_no int, " + ", ".join(f"c{i} string" for i in range(14))


def sheet(spark, cells):
    data = []
    for row_no, vals in cells:
        vals = list(vals) + [None] * (14 - len(vals))
        data.append(("S", row_no, *vals))
    return spark.createDataFrame(data, SHEET)


def test_assumptions_sections(spark):
    raw = sheet(
        spark,
        [
            (0, ["Assumptions"]),
            (3, ["Utilization Rate", "%", "0.65", "0.55", "0.75", "0.65"]),
            (4, [None, None]),
            (5, ["Total Fleet Size", "vehicles", "500", "350", "700", "500"]),
            (11, ["Price per Minute", "EUR", "0.29", "0.25", "0.33", "0.29"]),
            (20, ["Outside", "x"]),
        ],
    )
    a = rows(rs.assumptions_from_sheet(raw, [("Fleet & Utilization", 3, 9), ("Pricing", 11, 15)]), "driver_name")
    assert [(r["section"], r["driver_name"]) for r in a] == [
        ("Pricing", "Price per Minute"),
        ("Fleet & Utilization", "Total Fleet Size"),
        ("Fleet & Utilization", "Utilization Rate"),
    ]
    assert a[1]["low_case"] == "350"


def test_engine_cleaning(spark):
    raw = sheet(
        spark,
        [
            (10, ["Metric", "Unit", "Definition", "Value"]),
            (11, ["── VOLUME ──"]),
            (12, ["Rides", "rides", "fleet x util", "1000"]),
            (13, [None]),
            (14, ["Metric", "Unit", "Definition", "Value"]),
            (15, ["Hours", "h", "fleet x hours", "12"]),
        ],
    )
    e = rows(rs.engine_from_sheet(raw, 10, 23), "metric")
    assert [r["metric"] for r in e] == ["Hours", "Rides"]
    keep = rs.engine_from_sheet(raw, 10, 23, drop_dividers=False)
    assert keep.count() == 3  # the divider survives when not dropped (revenue sheet)


def test_pl_melt_and_totals(spark):
    months = [str(float(m)) for m in range(1, 13)]
    raw = sheet(
        spark,
        [
            (8, ["Metric"] + [f"Month {m}" for m in range(1, 13)] + ["FY Total"]),
            (9, ["EBITDA"] + months + ["78.0"]),
            (10, ["Not kept"] + months + ["78.0"]),
            (11, ["Revenue (Net)"] + ["x"] * 12 + ["1"]),
        ],
    )
    long, fy = rs.pl_from_sheet(raw, 8, 21, ["EBITDA", "Revenue (Net)"])
    lr = rows(long, "metric", "month_number")
    assert len(lr) == 24
    e = [r for r in lr if r["metric"] == "EBITDA"]
    assert [r["month_number"] for r in e] == list(range(1, 13))
    assert [r["value"] for r in e] == [float(m) for m in range(1, 13)]
    assert all(r["value"] is None for r in lr if r["metric"] == "Revenue (Net)")  # text cells -> NULL
    assert rows(fy, "metric")[0]["fy_total"] == 78.0


def test_matrix_to_long_roundtrip(spark):
    m = spark.createDataFrame([(0.21, 1.0, 2.0), (0.25, 3.0, None)], "x double, y_0p5 double, y_0p8 double")
    g = rows(rs.matrix_to_long(m, "x", {"y_0p5": 0.5, "y_0p8": 0.8}, "FY_Net_Revenue", "1A"), "x", "y")
    assert [(float(r["x"]), float(r["y"]), r["value"]) for r in g] == [
        (0.21, 0.5, 1.0),
        (0.21, 0.8, 2.0),
        (0.25, 0.5, 3.0),
        (0.25, 0.8, None),
    ]
    assert {r["table"] for r in g} == {"1A"}


def test_positional_rename_needs_as_many_names_as_columns(spark):
    raw = sheet(spark, [(0, ["a", "b"])])
    with pytest.raises(ValueError):
        rs.rename_positional(raw, ["x", "y"])
    assert rs.rename_positional(raw, ["x", "y"], rs.data_columns(raw, 2)).columns == ["sheet", "row_no", "x", "y"]


def test_sections_are_cut_from_one_sheet(spark):
    raw = sheet(spark, [(3, ["Utilization Rate", "%", "0.65"])])
    other = raw.withColumn("sheet", F.lit("Other")).withColumn("c0", F.lit("Elsewhere"))
    got = rs.assumptions_from_sheet(raw.unionByName(other), [("Fleet", 3, 9)], sheet="S")
    assert [r["driver_name"] for r in got.collect()] == ["Utilization Rate"]


def test_sheet_loads_keep_their_keys(spark):
    months = [str(float(m)) for m in range(1, 13)]
    raw = sheet(spark, [(8, ["Metric"]), (9, ["EBITDA"] + months + ["78.0"])]).withColumn("entity", F.lit("a"))
    raw = raw.unionByName(raw.withColumn("entity", F.lit("b")))
    long, fy = rs.pl_from_sheet(raw, 8, 21, ["EBITDA"], sheet="S", keys=["entity"])
    assert {r["entity"] for r in long.collect()} == {r["entity"] for r in fy.collect()} == {"a", "b"}
    tagged = rs.tag_snapshots(raw, {"S": "Base"})
    assert {r["scenario"] for r in tagged.collect()} == {"Base"}
    assert rs.tag_snapshots(raw, {"T": "Base"}).count() == 0


def test_axis_levels_come_from_the_sheet(spark):
    cells = [("M", 0, 1, "0.005"), ("M", 0, 2, "0.725"), ("M", 1, 0, "0.015"), ("M", 1, 1, "3.5"), ("M", 1, 2, None), ("N", 1, 1, "9")]
    raw = spark.createDataFrame(cells, "sheet string, row_no int, col_no int, cell string")
    got = rows(rs.cells_to_grid(raw, {"M": ("1A", "FY_Net_Revenue")}), "y")
    assert [(float(r["x"]), float(r["y"]), r["value"]) for r in got] == [(0.015, 0.005, 3.5), (0.015, 0.725, None)]


def test_stack_scenarios(spark):
    snap = spark.createDataFrame([(1, "EBITDA", 5.0)], "month_number int, metric string, value double")
    st = rs.stack_scenarios({"Low": snap, "Base": snap.withColumn("value", F.lit(6.0))})
    assert sorted((r["scenario"], r["value"]) for r in st.collect()) == [("Base", 6.0), ("Low", 5.0)]
