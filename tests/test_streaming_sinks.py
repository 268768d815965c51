"""Streaming audit of landed snapshots, and the write / read-back load job."""

import os
import subprocess
import sys
import tempfile

import fixtures as fx
import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria import schema as S
from scenaria.operators import timeseries as ts
from scenaria.sources import sinks
from scenaria.streaming.audit import landed_fact_schema, reconcile_stream

SF_DIR = "/root/testdata/sf0.001"


def test_reconcile_stream_audits_each_landed_snapshot(spark):
    root = tempfile.mkdtemp(prefix="scenaria-stream-")
    landing, report = os.path.join(root, "landing"), os.path.join(root, "report")
    schema = landed_fact_schema(["entity"])
    good = spark.createDataFrame(fx.fact_pdf(entities=["a"]), schema)
    bad = spark.createDataFrame(fx.fact_pdf(entities=["b"]), schema).withColumn(
        "value", F.when(F.col("metric") == S.EBITDA, F.col("value") + 1.0).otherwise(F.col("value"))
    )
    good.coalesce(1).write.parquet(os.path.join(landing, "load1"))
    q = reconcile_stream(spark, os.path.join(landing, "*"), report, keys=["entity"], checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    bad.coalesce(1).write.parquet(os.path.join(landing, "load2"))
    q = reconcile_stream(spark, os.path.join(landing, "*"), report, keys=["entity"], checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    out = rows(spark.read.parquet(report))
    assert len(out) == 72  # each snapshot audited exactly once
    by_entity = {}
    for r in out:
        by_entity.setdefault(r["entity"], set()).add(r["integrity_status"])
    assert by_entity == {"a": {"PASS"}, "b": {"FAIL"}}
    assert len({r["batch_id"] for r in out}) == 2


def test_load_job_writes_and_reads_back(spark):
    out = tempfile.mkdtemp(prefix="scenaria-load-")
    root = sinks.load_planning_tables(spark, SF_DIR, out)
    t = sinks.read_planning_tables(spark, root)
    counts = {r["table_name"]: r["n_rows"] for r in sinks.audit_loaded(t).collect()}
    again = sinks.load_planning_tables(spark, SF_DIR, out)
    assert again != root and os.path.isdir(root)  # a load is a new version; earlier ones stay
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.read_planning_tables(spark, out)  # no complete version
    assert counts["pl_monthly"] > 0 and counts["pl_fy_totals"] > 0 and counts["assumptions"] == 6
    # analyses on the loaded tables equal those on the freshly derived marts
    from scenaria.sources import marts

    fresh = rows(ts.margin_of_safety(marts.fact(spark, SF_DIR), keys=marts.PL_KEYS), "entity", "fiscal_year", "scenario", "month")
    loaded = rows(ts.margin_of_safety(t["pl_monthly"], keys=marts.PL_KEYS), "entity", "fiscal_year", "scenario", "month")
    assert fresh == loaded


def test_stream_audits_planning_fact_files(spark):
    """Files of the planning fact itself (entity, fiscal_year keys) stream through the default keys."""
    from scenaria.sources import marts

    root = tempfile.mkdtemp(prefix="scenaria-stream2-")
    marts.fact(spark, SF_DIR).write.parquet(os.path.join(root, "landing", "load1"))
    q = reconcile_stream(spark, os.path.join(root, "landing", "*"), os.path.join(root, "report"),
                         checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "report"))
    assert out.count() == marts.fact(spark, SF_DIR).select("entity", "fiscal_year", "scenario", "month_number").distinct().count()
    assert {r["integrity_status"] for r in out.select("integrity_status").distinct().collect()} == {"PASS"}


def test_checkpoint_dir_reads_the_session_setting(spark):
    from scenaria.session import checkpoint_dir

    d = checkpoint_dir(spark)
    assert d and d == checkpoint_dir(spark)  # stable once set
    assert spark.sparkContext.getCheckpointDir() is not None


def test_analyses_on_loaded_tables_equal_fresh_ones(spark):
    from scenaria.operators import audit as au
    from scenaria.operators import grid as gr
    from scenaria.plans import catalog
    from scenaria.sources import marts

    out = tempfile.mkdtemp(prefix="scenaria-load2-")
    t = sinks.read_planning_tables(spark, sinks.load_planning_tables(spark, SF_DIR, out))
    keys = marts.PL_KEYS
    order = ("entity", "fiscal_year", "scenario", "month")
    loaded = rows(ts.cumulative_payback(t["pl_monthly"], t["pl_fy_totals"], keys=keys), *order)
    assert loaded == rows(catalog.cumulative_payback(spark, SF_DIR), *order)
    assert rows(au.reconcile(t["pl_monthly"], keys=keys), *order) == rows(catalog.reconcile(spark, SF_DIR), *order)
    levers = [
        gr.GridLevers(t["sensitivity_all_lines"], "Discount", "Tax", *marts.GRID_BASE),
        gr.GridLevers(t["sensitivity_growth"], "Price_Growth", "Volume_Growth", *marts.GROWTH_BASE),
    ]
    assert rows(gr.lever_ranking(levers), "output", "lever") == rows(catalog.lever_ranking(spark, SF_DIR), "output", "lever")


def test_command_line_runner_writes_results(spark):
    from scenaria.__main__ import main

    out = tempfile.mkdtemp(prefix="scenaria-cli-")
    assert main(["load_audit", SF_DIR, out]) == 0
    got = {r["table_name"]: r["n_rows"] for r in spark.read.parquet(os.path.join(out, "load_audit")).collect()}
    assert set(got) == {*sinks.PLANNING_TABLES, "lines_without_scenario", "lines_without_entity"}
    assert main(["no_such_analysis", SF_DIR]) == 2


def test_command_line_prints_every_row(spark, capsys):
    from scenaria.__main__ import main
    from scenaria.plans.catalog import QUERIES

    n = QUERIES["scenario_spread"](spark, SF_DIR).count()
    capsys.readouterr()
    assert main(["scenario_spread", SF_DIR]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == n + 2 > 52


def test_streams_have_checkpoints_of_their_own(spark):
    from scenaria.streaming import audit

    root = tempfile.mkdtemp(prefix="scenaria-stream3-")
    schema = landed_fact_schema(["entity"])
    for name in ("a", "b"):
        spark.createDataFrame(fx.fact_pdf(entities=[name]), schema).write.parquet(f"{root}/{name}/load1")
        audit.reconcile_stream(spark, f"{root}/{name}/*", f"{root}/report-{name}", keys=["entity"]).awaitTermination(120)
    assert spark.read.parquet(f"{root}/report-b").count() == 36


def test_submitted_master_is_kept():
    """Without a session of its own, the command line takes the master that the launcher names."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "from scenaria.__main__ import session; print('MASTER', session().sparkContext.master)"
    env = {**os.environ, "PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "MASTER local[2]" in out.stdout, out.stderr[-500:]


def test_a_cluster_must_name_its_checkpoint_folder():
    from scenaria.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
