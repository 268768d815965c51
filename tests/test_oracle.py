"""Every registered analysis against its SQL oracle on DuckDB (sf0.001 tables)."""

import math
import os

import duckdb
import pytest

from scenaria.plans.catalog import QUERIES
from scenaria.plans.sql import ORACLE
from scenaria.sources.tables import TABLES, table_path

SF_DIR = os.environ.get("SCENARIA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_DIR, t)}')")
    yield con
    con.close()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(pdf, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert len(got) == len(want) > 0
    assert _rows(got, cols) == _rows(want, cols)
