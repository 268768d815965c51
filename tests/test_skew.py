"""A hot join key (about half of all lines on one order) still plans, splits and matches the oracle."""

import os
import tempfile

import duckdb
import pytest

from scenaria.plans.catalog import QUERIES
from scenaria.plans.sql import ORACLE

SRC = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SRC), reason="test tables not present")


@pytest.fixture(scope="module")
def skewed_dir():
    d = tempfile.mkdtemp(prefix="scenaria-skew-")
    con = duckdb.connect()
    for t in ("customer", "orders", "part"):
        con.execute(f"COPY (SELECT * FROM '{SRC}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT PARQUET)")
    # every line appears once more, re-assigned to the first order: that order holds ~half the lines.
    # Written as several files: AQE splits a skewed partition by ranges of map tasks, so it needs
    # more than one (a cluster reading 100 TB has thousands).
    os.makedirs(f"{d}/lineitem.parquet")
    for part in range(4):
        con.execute(
            f"""COPY (
                SELECT * FROM (
                    SELECT * FROM '{SRC}/lineitem.parquet'
                    UNION ALL
                    SELECT * REPLACE ((SELECT min(o_orderkey) FROM '{SRC}/orders.parquet') AS l_orderkey)
                    FROM '{SRC}/lineitem.parquet'
                ) WHERE l_linenumber % 4 = {part}
            ) TO '{d}/lineitem.parquet/part-{part}.parquet' (FORMAT PARQUET)"""
        )
    return d


SKEW_CONF = {
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_order_key_is_split_and_results_match(spark, skewed_dir):
    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        df = QUERIES["reconcile"](spark, skewed_dir)
        got = df.toPandas()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin(skew=true)" in plan or "isSkewJoin=true" in plan
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    con = duckdb.connect()
    for t in ("customer", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{skewed_dir}/{t}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{skewed_dir}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLE["reconcile"]).df()
    cols = sorted(got.columns)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got[cols].astype(object).values.tolist()), key=key) == sorted(
        map(tuple, want[cols].astype(object).values.tolist()), key=key
    )
