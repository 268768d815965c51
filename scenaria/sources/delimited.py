"""Typed loads of delimited exports: good rows with the declared types, bad ones as a table of their own.

The reader takes every column as text and casts it itself, so one pass tells good rows from bad ones and
says why. ``load`` writes both with one job, and the counts come with the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.sources import sinks

REASON, RECORD, FILE = "_reason", "_record", "_file"


def read(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = False, sep: str = ",") -> DataFrame:
    """The export's rows with the declared types, and ``_reason``, ``_record``, ``_file``.

    ``_reason`` is NULL on good rows. It is ``columns`` where a line has more or fewer values than the
    schema has columns, otherwise the first column whose text has not its type, or is missing where the
    schema forbids NULL; ``_record`` then holds the line. Empty text is NULL; quotes inside quotes are doubled. With ``header``, names that
    differ from the schema's are an error.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(RECORD, T.StringType())])
    reader = spark.read.schema(text).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, header=header, enforceSchema=False, sep=sep, escape='"', columnPruning=False
    )
    rows = reader.csv(path)
    reason: Column = F.when(F.col(RECORD).isNotNull(), F.lit("columns"))
    for f in schema.fields:
        given = F.col(f.name)
        bad = given.isNotNull() & given.try_cast(f.dataType).isNull()
        reason = reason.when(bad if f.nullable else bad | given.isNull(), F.lit(f.name))
    line = F.coalesce(F.col(RECORD), F.concat_ws(sep, *[F.coalesce(F.col(f.name), F.lit("")) for f in schema.fields]))
    return rows.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
        reason.alias(REASON),
        F.when(reason.isNotNull(), line).alias(RECORD),
        F.col("_metadata.file_path").alias(FILE),
    )


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(REASON).isNull()).drop(REASON, RECORD, FILE)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(REASON).isNotNull()).select(REASON, RECORD, FILE)


def load(spark: SparkSession, path: str, schema: str | T.StructType, out: str, **options) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Reads the export once and writes good and bad rows: (good rows, bad rows, counts of the write)."""
    rows = read(spark, path, schema, **options)
    bad = F.col(REASON).isNotNull()
    counts = sinks.write_counted(
        rows.withColumn("is_rejected", bad), out, partition_by=["is_rejected"], n_rejected=F.count(F.when(bad, 1))
    )
    counts["n_good"] = counts["n_rows"] - counts["n_rejected"]
    written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("is_rejected", T.BooleanType())])).parquet(out)
    return good(written.where("NOT is_rejected").drop("is_rejected")), rejected(written.where("is_rejected")), counts
