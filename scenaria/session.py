"""Spark session helpers.

On a cluster the session comes from the platform; ``configure`` only sets
the SQL options the operators rely on and never overrides a checkpoint
directory that the cluster already names.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SQL_DEFAULTS = {
    # Runtime re-planning: coalesce small shuffles, split skewed join partitions,
    # and turn joins into broadcasts only when the measured side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No broadcast from static estimates (file sizes of a projected scan can
    # make the big side of a join look small); AQE broadcasts a join side only
    # after its shuffle stage has run and measured under the threshold.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only on a local master is a scratch folder created where it is unset (as in tests); on a cluster,
    whose machines would not share such a folder, that is an error. Works on classic sessions and,
    through the setting alone, on Spark Connect.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
    if not d:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        d = tempfile.mkdtemp(prefix="scenaria-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # some deployments refuse runtime changes of core settings
            pass
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scenaria") -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SCENARIA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark)
    return spark
