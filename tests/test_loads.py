"""Typed delimited loads, replaceable snapshots, counts that come with the write."""

import os

import pytest
from pyspark.sql import functions as F
from result_rows import rows

from scenaria.sources import delimited, sinks
from scenaria.sources.snapshots import SnapshotTable

SCHEMA = "id BIGINT NOT NULL, name STRING, price DECIMAL(9,2), day DATE, n INT"
GOOD = ['1,plain,1.50,2024-01-31,7', '2,"quoted, with ""marks""",,2024-02-29,', '3,,0.1,,-1', "9223372036854775807,é,9999999.99,0001-01-01,0"]
BAD = {
    "4,too,few": "columns",
    "5,too,1.0,2024-01-01,1,many": "columns",
    "x,key,1.0,2024-01-01,1": "id",
    ",key,1.0,2024-01-01,1": "id",
    "6,price,1.0.0,2024-01-01,1": "price",
    "7,day,1.0,2023-02-29,1": "day",
    "8,n,1.0,2024-01-01,1.5x": "n",
}


def test_good_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([*GOOD[:2], *BAD]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(GOOD[2:]))
    read = delimited.read(spark, str(tmp_path), SCHEMA)
    assert delimited.good(read).select("id").count() == 4  # whatever columns are asked for
    good, bad, counts = delimited.load(spark, str(tmp_path), SCHEMA, f"{tmp_path}/loaded")
    assert counts == {"n_rows": 11, "n_rejected": 7, "n_good": 4}
    assert [(r["id"], r["name"], r["price"] and float(r["price"]), str(r["day"]), r["n"]) for r in rows(good, "id")] == [
        (1, "plain", 1.5, "2024-01-31", 7),
        (2, 'quoted, with "marks"', None, "2024-02-29", None),
        (3, None, 0.1, "None", -1),
        (2**63 - 1, "é", 9999999.99, "0001-01-01", 0),
    ]
    assert {r["_record"]: r["_reason"] for r in bad.collect()} == BAD
    assert all(r["_file"].endswith("a.csv") for r in bad.collect())


def test_header_must_name_the_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    assert delimited.good(delimited.read(spark, str(tmp_path), "id INT, name STRING", header=True)).collect() == [(1, "x")]
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read(spark, str(tmp_path), "id INT, title STRING", header=True).collect()


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if "_SUCCESS" not in f}


def table_rows(t, version=None):
    return sorted((r["scenario"], r["month"], r["value"]) for r in t.read(version).collect())


def test_one_snapshot_is_replaced(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "fact"))
    assert t.version() is None and t.current() == {}
    fact = {s: spark.createDataFrame([(s, m, float(m * k)) for m in (1, 2, 3)], "scenario string, month int, value double") for k, s in enumerate(("Low", "Base", "High"))}
    versions = [t.replace(s, df) for s, df in fact.items()]
    assert versions == sorted(set(versions)) and t.version() == versions[-1]
    everything = sorted((s, m, float(m * k)) for k, s in enumerate(fact) for m in (1, 2, 3))
    assert table_rows(t) == everything

    before, paths = files(tmp_path), {s: x.path for s, x in t.current().items()}
    less = fact["Low"].where("month < 3")
    new = t.replace("Low", less)
    assert {f: x for f, x in files(tmp_path).items() if f in before} == before  # nothing is touched
    assert {s: x.path for s, x in t.current().items() if s != "Low"} == {s: p for s, p in paths.items() if s != "Low"}
    assert table_rows(t) == [r for r in everything if r[:2] != ("Low", 3)]
    assert table_rows(t, versions[-1]) == everything  # earlier versions can still be read

    assert t.replace("Low", less.orderBy(F.desc("month"))) == new  # the same rows again
    broken = fact["High"].withColumn("value", F.when(F.col("month") == 2, F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="torn"):
        t.replace("High", broken)
    with pytest.raises(Exception, match="row of another snapshot"):
        t.replace("High", fact["Low"])
    assert t.version() == new and table_rows(t) == [r for r in everything if r[:2] != ("Low", 3)]

    t.replace("Low", less.where("false"))  # a snapshot may be empty
    assert table_rows(t) == [r for r in everything if r[0] != "Low"] and t.current()["Low"].n_rows == 0


def test_snapshots_are_pruned(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "fact"))
    for s in ("Low", "Base"):
        t.replace(s, spark.range(5).withColumn("value", F.col("id") * 2))
    plan = t.read().where("scenario = 'Low'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id"))).withColumn("p", F.col("id") % 3)
    got = sinks.write_counted(df, f"{tmp_path}/t", partition_by=["p"], sort_within=["v"], nulls=F.count(F.when(F.col("v").isNull(), 1)), top=F.max("id"))
    assert got == {"n_rows": 1000, "nulls": 100, "top": 999}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000
    assert sinks.write_counted(df.where("id < 0"), f"{tmp_path}/none")["n_rows"] == 0
    a, b = (sinks.write_counted(x, f"{tmp_path}/{n}", c=sinks.fingerprint(x))["c"] for n, x in (("a", df), ("b", df.repartition(7).sortWithinPartitions("v"))))
    assert a == b != sinks.write_counted(df.where("id > 0"), f"{tmp_path}/c", c=sinks.fingerprint(df))["c"]
