"""Helpers shared by the training-data operators: table reads, shared scratch tables, row keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenaria.session import checkpoint_dir

#: Session options of every operator query. Shuffle files go when the job that wrote them ends: each
#: multi-step operator cuts its lineage with tables in the shared folder, so no later job reads them.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Texts are long: small Arrow batches keep the Python workers' memory low.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Gives the package to the Python workers, once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """Sets the operators' session options and ships their code."""
    for k, v in OPTIONS.items():
        spark.conf.set(k, v)
    ship_code(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder; the session options are set on the way."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """A folder of its own in ``spark.checkpoint.dir`` for the tables of one operator run.

    ``save`` writes a DataFrame as Parquet and reads it back with its schema, which cuts the lineage:
    a lost executor recomputes from files that all executors share. ``drop`` deletes tables that no
    DataFrame still to be computed reads; the others stay until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str, within: str | None = None):
        self.spark = spark
        self.root = f"{(within or checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.saved: list[tuple[DataFrame, str]] = []

    def part(self, name: str) -> Scratch:
        """A folder within this one, for steps whose tables go together."""
        return Scratch(self.spark, name, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self._back(df.schema, path)

    def save_parts(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """Writes the parts, which have the same columns, one after another to one table."""
        self.n += 1
        path, schema = f"{self.root}/{self.n:03d}-{name}", None
        for df in parts:
            df.write.mode("append").parquet(path)
            schema = df.schema
        return self._back(schema, path)

    def _back(self, schema: StructType, path: str) -> DataFrame:
        table = self.spark.read.schema(schema).parquet(path)
        self.saved.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of the given tables, which ``save`` returned; without any, the whole folder."""
        gone = [(t, path) for t, path in self.saved if not tables or any(t is x for x in tables)]
        for path in [path for _, path in gone] if tables else [self.root]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.saved = [(t, path) for t, path in self.saved if not any(t is x for x, _ in gone)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")
