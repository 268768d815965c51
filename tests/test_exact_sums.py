"""Sums beyond 64 bits, axis levels off the whole percent, and inputs that the marts refuse."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria.operators import portfolio as pf
from scenaria import schema as S
from scenaria.plans.catalog import QUERIES
from scenaria.plans.sql import ORACLE
from scenaria.sources import marts

SRC = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SRC), reason="test tables not present")


def tables(tmp_path, lineitem: str) -> str:
    con = duckdb.connect()
    for t in ("customer", "orders", "part"):
        con.execute(f"COPY (SELECT * FROM '{SRC}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT PARQUET)")
    con.execute(f"COPY ({lineitem.format(src=SRC)}) TO '{tmp_path}/lineitem.parquet' (FORMAT PARQUET)")
    return str(tmp_path)


def against_sql(spark, d: str, name: str):
    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    key = lambda f: sorted(map(tuple, f[cols].astype(object).where(f[cols].notna(), None).values.tolist()), key=repr)
    assert key(got) == key(want), name
    return got


def test_a_group_beyond_64_bits_is_exact(spark, tmp_path):
    # amounts are 1e-8 units: one plan month of about 2e5 lines at 9e7 each is far beyond 2^63 units
    d = tables(
        tmp_path,
        "SELECT l.* REPLACE (90000000.25::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, 0.04::DOUBLE AS l_tax, "
        "TIMESTAMP '1995-03-05' AS l_shipdate, 'A' AS l_returnflag) FROM '{src}/lineitem.parquet' l, range(30)",
    )
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert lines * 90000000.25 * 0.95 * 1e8 > 2**63
    fact = marts.wide_pl(spark, d).agg(F.sum(F.col(f"`{S.REVENUE}`")).alias("r")).first().r
    assert fact == pytest.approx(lines * 90000000.25 * 0.95, rel=1e-15)
    cells = marts.grid_cells(spark, d).select("rev").collect()
    from decimal import Decimal

    assert sum(r.rev for r in cells) == lines * Decimal("90000000.25") * Decimal("0.95")
    assert {r.disc_u for r in marts.grid_cells(spark, d).collect()} == {500}


def test_levels_off_the_whole_percent_stay_apart(spark, tmp_path):
    d = tables(
        tmp_path,
        "SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN 0.055 ELSE l_discount END AS l_discount, "
        "CASE WHEN l_linenumber = 2 THEN 0.19 WHEN l_linenumber = 3 THEN 0.0725 ELSE l_tax END AS l_tax) "
        "FROM '{src}/lineitem.parquet'",
    )
    flat = against_sql(spark, d, "flatten_grid")
    assert {0.055} <= set(flat.x) and {0.19, 0.0725} <= set(flat.y)
    matrix = against_sql(spark, d, "sensitivity_matrix")
    assert len(matrix) == matrix.x.nunique() * matrix.y.nunique() > 99
    for name in ("grid_audit", "lever_ranking", "load_audit", "kpi_totals"):
        against_sql(spark, d, name)


def test_lines_without_a_scenario_are_reported(spark, tmp_path):
    d = tables(tmp_path, "SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM '{src}/lineitem.parquet'")
    audit = against_sql(spark, d, "load_audit")
    assert audit.set_index("table_name").n_rows["lines_without_scenario"] > 0


def test_more_than_four_decimals_are_refused(spark, tmp_path):
    d = tables(tmp_path, "SELECT * REPLACE (0.012345::DOUBLE AS l_discount) FROM '{src}/lineitem.parquet'")
    with pytest.raises(Exception, match="more than four decimals"):
        QUERIES["flatten_grid"](spark, d).collect()


def test_a_listed_matrix_refuses_other_levels(spark):
    g = marts.grid(spark, SRC)
    levels = [f"0.0{i}" for i in range(9)]
    assert pf.sensitivity_matrix(g, S.OUT_MARGIN, levels).count() == 11
    with pytest.raises(Exception, match="not in y_levels"):
        pf.sensitivity_matrix(g, S.OUT_MARGIN, levels[:-1]).collect()


def test_limbs_of_negative_amounts(spark):
    df = spark.createDataFrame([(-1,), (-(2**40) - 7,), (2**50 + 3,)], "u long").agg(*marts.limb_sums(s="u"))
    assert rows(df.selectExpr(f"CAST({marts.limbs_sql('s', 8)} * 100000000 AS DECIMAL(30,0)) AS t"))[0]["t"] == -1 - 2**40 - 7 + 2**50 + 3
