"""Sinks and the load job: write the planning tables once, read them back for the analyses.

``write_table`` replaces a table (E16): an overwrite of a Parquet dataset,
optionally partitioned, with rows sorted within each output file (E13) so
readers get ordered, well-compressed files without a global sort.

``load_planning_tables`` is the load step of the workflow: it derives the
planning tables from the warehouse and writes them under a shared folder
(by default the cluster's ``spark.checkpoint.dir``), which also cuts the
lineage of every later analysis: a lost executor recomputes from those
files, not from the warehouse joins. ``read_planning_tables`` opens them.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scenaria.operators.audit import load_audit
from scenaria.session import checkpoint_dir
from scenaria.sources import marts


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Iterable[str] = (),
    sort_within: Iterable[str] = (),
    mode: str = "overwrite",
) -> None:
    """Replace the Parquet dataset at ``path`` with ``df``."""
    sort_within = list(sort_within)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    partition_by = list(partition_by)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def fingerprint(df: DataFrame) -> Column:
    """A number that tells the rows of ``df`` from others, whatever their order: for use among the counts of a write."""
    halves = F.xxhash64(*df.columns)
    return F.concat_ws(":", F.sum(F.shiftrightunsigned(halves, 32)), F.sum(halves.bitwiseAND(0xFFFFFFFF)))


def write_counted(
    df: DataFrame,
    path: str,
    partition_by: Iterable[str] = (),
    sort_within: Iterable[str] = (),
    mode: str = "overwrite",
    **metrics: Column,
) -> dict:
    """``write_table`` that returns ``n_rows`` and the given aggregates of the rows written, worked out by the write itself."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[m.alias(n) for n, m in metrics.items()]), path, partition_by, sort_within, mode)
    return seen.get


# Partition and sort-within columns of the planning tables.
PLANNING_TABLES = {
    "pl_monthly": (("scenario",), ("entity", "month_number", "metric")),
    "pl_fy_totals": ((), ("entity", "scenario", "metric")),
    "assumptions": ((), ("driver_name",)),
    "sensitivity_all_lines": ((), ("output", "x", "y")),
    "sensitivity_closed_lines": ((), ("output", "x", "y")),
    "sensitivity_growth": ((), ("output", "x", "y")),
}


def write_bucketed(df: DataFrame, table: str, path: str, by: Iterable[str], buckets: int, sort_by: Iterable[str] = ()) -> DataFrame:
    """E13: replaces ``table``, whose files at ``path`` are bucketed by the plan keys and sorted in each bucket.

    Analyses that group, join or window by these keys, and perhaps more, read it without an exchange. One
    task writes one bucket, so ``buckets`` should give buckets of some hundred MB; as buckets are never
    split, keys by which no plan outweighs a bucket are the ones to take. The catalog remembers the table;
    ``open_bucketed`` makes it known to a session whose catalog is its own.
    """
    by, sort_by = list(by), list(sort_by)
    writer = df.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by)
    (writer.sortBy(*sort_by) if sort_by else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, by: Iterable[str], buckets: int, sort_by: Iterable[str] = ()) -> DataFrame:
    """The table that ``write_bucketed`` wrote to ``path``, under a name in this session's catalog."""
    columns = spark.read.parquet(path).schema
    quoted = lambda names: ", ".join(f"`{c}`" for c in names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    order = f" SORTED BY ({quoted(sort_by)})" if list(sort_by) else ""
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({quoted(by)}){order} INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def planning_dir(spark: SparkSession, out_dir: str | None = None) -> str:
    return (out_dir or f"{checkpoint_dir(spark)}/planning").rstrip("/")


def load_planning_tables(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> str:
    """Build and write every planning table as a new version; returns the version's folder.

    The warehouse is read once per mart: months and years of the plans come from one aggregate, all grids
    from another. Their small results are written first, and the tables are derived from what was written.
    A version is complete when its ``_loaded`` table (row counts by table, taken while writing) is there, which
    is written last;
    a failed load leaves earlier versions untouched.
    """
    root = f"{planning_dir(spark, out_dir)}/version-{time.time_ns()}"
    levels = _written(marts.wide_levels(spark, sf_dir), f"{root}/_plan_levels")
    cells = _written(marts.grid_cells_all_and_by_status(spark, sf_dir), f"{root}/_grid_cells")
    fact, totals = marts.views(levels)
    all_lines, closed = marts.split_cells(cells)
    tables = {
        "pl_monthly": fact,
        "pl_fy_totals": totals,
        "assumptions": marts.assumptions(spark, sf_dir),
        "sensitivity_all_lines": marts.grid_from_cells(all_lines, ("1A", "1B")),
        "sensitivity_closed_lines": marts.grid_from_cells(closed, ("2A", "2B")),
        "sensitivity_growth": marts.growth_grid(all_lines),
    }
    counts = [
        (name, write_counted(tables[name], f"{root}/{name}", partition_by=part, sort_within=order)["n_rows"])
        for name, (part, order) in PLANNING_TABLES.items()
    ]
    write_table(spark.createDataFrame(counts, "table_name string, n_rows bigint").coalesce(1), f"{root}/_loaded")
    return root


def _written(df: DataFrame, path: str) -> DataFrame:
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_planning_tables(spark: SparkSession, version_dir: str) -> dict[str, DataFrame]:
    """The tables of a complete version; an incomplete one is an error."""
    root = version_dir.rstrip("/")
    spark.read.parquet(f"{root}/_loaded")
    return {name: spark.read.parquet(f"{root}/{name}") for name in PLANNING_TABLES}


def loaded_counts(spark: SparkSession, version_dir: str) -> DataFrame:
    """E17: the row counts that came with the writes of a version: (table_name, n_rows)."""
    return spark.read.parquet(f"{version_dir.rstrip('/')}/_loaded")


def audit_loaded(tables: Mapping[str, DataFrame]) -> DataFrame:
    """E17: row count of every loaded table."""
    return load_audit(tables)
