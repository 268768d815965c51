"""A table of snapshots, each of which can be replaced by itself.

Every load of a snapshot goes to a folder of its own, ``data/<by>=<snapshot>/load=<id>``, which nothing reads
until a manifest names it. A manifest is one small file that lists the current load of every snapshot with
its row count and fingerprint; it is written after the load's files are complete and counted again, and the
newest one is the table. So a load that fails is never visible, loading one snapshot leaves the files of the
others alone, and a reader sees the table before or after a load. A load of the rows that are there already
changes nothing. Loads of one table must not run at the same time. Files that no manifest names any more are
left for the storage's own clean-up, as readers may still use them.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.sources import sinks

MANIFEST = "version bigint, snapshot string, path string, n_rows bigint, fingerprint string"


class Load(NamedTuple):
    path: str
    n_rows: int
    fingerprint: str


class SnapshotTable:
    """The snapshots under ``root``; ``by`` is the column that tells them apart."""

    def __init__(self, spark: SparkSession, root: str, by: str = "scenario"):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by

    def version(self) -> int | None:
        """The newest version, or None for a table without loads."""
        rows = self._manifests()
        return rows.agg(F.max("version")).collect()[0][0] if rows is not None else None

    def current(self, version: int | None = None) -> dict[str, Load]:
        """The loads of a version (the newest one) by snapshot."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        rows = self._manifests().where(F.col("version") == version).collect()
        if not rows:
            raise ValueError(f"{self.root} has no version {version}")
        return {r.snapshot: Load(r.path, r.n_rows, r.fingerprint) for r in rows}

    def replace(self, snapshot: str, df: DataFrame) -> int:
        """Makes the rows of ``df`` the snapshot's rows; the version that holds them.

        A column named like ``by`` must hold the snapshot's name in every row, or the load fails.
        """
        if self.by in df.columns:
            other = F.raise_error(F.concat(F.lit(f"row of another snapshot: {self.by} = "), F.coalesce(F.col(self.by).cast("string"), F.lit("NULL"))))
            df = df.where(F.when(F.col(self.by).eqNullSafe(F.lit(snapshot)), True).otherwise(other.cast("boolean"))).drop(self.by)
        path = f"data/{self.by}={snapshot}/load={uuid.uuid4().hex}"
        counts = sinks.write_counted(df, f"{self.root}/{path}", content=sinks.fingerprint(df))
        load = Load(path, counts["n_rows"], f"{counts['n_rows']}:{counts['content']}")
        again = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").count()
        if again != load.n_rows:
            raise ValueError(f"{path}: {load.n_rows} rows written, {again} read back")
        before = self.version()
        loads = self.current(before) if before is not None else {}
        if snapshot in loads and loads[snapshot].fingerprint == load.fingerprint:
            return before
        loads[snapshot] = load
        version = max(time.time_ns(), (before or 0) + 1)
        rows = self.spark.createDataFrame([(version, s, *x) for s, x in loads.items()], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest one), with the snapshot's name in ``by``."""
        loads = self.current(version)
        if not loads:
            raise ValueError(f"{self.root} has no snapshots")
        paths = [f"{self.root}/{x.path}" for x in loads.values()]
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths).drop("load")
        return rows.withColumn(self.by, F.col(self.by).cast("string"))

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
