"""Audit every newly landed fact snapshot as it arrives.

The reconciliation checks are meant to run after every data load. As a
stream: new Parquet files in a landing folder are the micro-batches, and
``foreachBatch`` runs the batch ``reconcile`` operator on each one. Each batch
writes its report to its own ``batch_id=<n>`` folder with overwrite, so a
batch replayed after a failure replaces its earlier partial output: together
with the checkpointed source offsets the report is exactly-once.

A landed file must hold complete (entity, scenario, period) series; checks
see one micro-batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scenaria import schema as S
from scenaria.operators.audit import reconcile
from scenaria.session import checkpoint_dir


# Key columns of the planning fact and their types.
PL_KEY_TYPES = {"entity": T.StringType(), "fiscal_year": T.IntegerType()}


def landed_fact_schema(keys: Iterable[str] = tuple(PL_KEY_TYPES)) -> T.StructType:
    """Schema of landed fact files: the key columns (typed as in the marts; others text) + the fact."""
    return S.with_keys(S.FACT, {k: PL_KEY_TYPES.get(k, T.StringType()) for k in keys})


def reconcile_stream(
    spark: SparkSession,
    landing_dir: str,
    report_dir: str,
    keys: Iterable[str] = tuple(PL_KEY_TYPES),
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    strict: bool = True,
) -> StreamingQuery:
    """Start the streaming audit; returns the running query.

    ``available_now`` processes everything landed so far and stops (a
    scheduled load audit); ``False`` keeps watching the folder.
    """
    keys = list(keys)
    if checkpoint is None:
        # One checkpoint per landing and report folder: streams never share a file log.
        name = hashlib.sha256(f"{landing_dir}\n{report_dir}".encode()).hexdigest()[:16]
        checkpoint = f"{checkpoint_dir(spark).rstrip('/')}/streams/reconcile-{name}"
    reader = spark.readStream.schema(landed_fact_schema(keys))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.parquet(landing_dir)

    def audit_batch(batch: DataFrame, batch_id: int) -> None:
        report = reconcile(batch, strict=strict, keys=keys).withColumn("batch_id", F.lit(batch_id))
        report.write.mode("overwrite").parquet(f"{report_dir.rstrip('/')}/batch_id={batch_id}")

    writer = src.writeStream.foreachBatch(audit_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
