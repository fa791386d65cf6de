"""Table digests and the master table that is changed by bucket."""

import os

import pytest
from pyspark.sql import functions as F

from setgauge.operators import assemble as asm


def wide(spark, n=300):
    rows = [(i, i / 7, None if i % 5 == 0 else float(i % 3), None) for i in range(n)]
    return spark.createDataFrame(rows, "set_id long, a double, b double, c double")


def reports(got):
    return {r["feature"]: tuple(r)[1:] for r in got.collect()}


def test_parity_of_equal_tables_compares_no_rows(spark, monkeypatch):
    one = wide(spark)
    calls, join = [], type(one).join
    monkeypatch.setattr(type(one), "join", lambda *args, **kwargs: calls.append(1) or join(*args, **kwargs))
    got = reports(asm.table_parity(one, one.repartition(7), ["a", "b", "c"]))
    assert got == {"a": (300, 300, 300, True), "b": (240, 240, 300, True), "c": (0, 0, 300, True)}
    assert len(calls) == 1  # the digests of the buckets, nothing else


@pytest.mark.parametrize("buckets", [1, 8, 4096])
def test_parity_of_different_tables(spark, buckets):
    """As the report that joins everything: changed, swapped, missing, added and repeated rows."""
    want = wide(spark)
    other = want.filter("set_id <> 3").withColumn("a", F.when(F.col("set_id") == 10, 0.5).otherwise(F.col("a")))
    # two values change places, so sums of values stay the same, and so does the number of missing ones
    other = other.withColumn("swap", F.col("b")).withColumns({"b": F.when(F.col("set_id") == 20, F.col("a")).otherwise(F.col("b")), "a": F.when(F.col("set_id") == 20, F.col("swap")).otherwise(F.col("a"))}).drop("swap")
    extra = spark.createDataFrame([(1000, 1.0, 2.0, 3.0), (5, None, None, None)], want.schema)
    got = other.unionByName(extra)
    features = ["a", "b", "c"]
    joined = asm.parity_report(asm.long_features(want, features, digits=12), asm.long_features(got, features, digits=12))
    assert reports(asm.table_parity(want, got, features, buckets=buckets)) == reports(joined)
    assert reports(asm.table_parity(want.limit(0), want.limit(0), features))["a"][:3] == (0, 0, 0)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "master")
    base = spark.range(500).select(F.concat(F.lit("v"), F.col("id")).alias("video_name"), F.col("id").alias("n"))
    asm.write_master(base, path, "video_name", 16)
    before = files(path)
    new = spark.createDataFrame([("v7", -1), ("fresh", -2)], "video_name string, n long")
    asm.upsert_master(spark, path, new, "video_name", 16)
    after = files(path)
    touched = {r[0] for r in new.select(asm._bucket("video_name", 16)).collect()}
    bucket = lambda name: int(name.split("bucket=")[1].split("/")[0])
    assert {f: t for f, t in before.items() if bucket(f) not in touched} == {f: t for f, t in after.items() if bucket(f) not in touched}
    rows = {r["video_name"]: r["n"] for r in asm.read_master(spark, path).collect()}
    assert rows == {f"v{i}": i for i in range(500)} | {"v7": -1, "fresh": -2}
    assert sorted(map(tuple, asm.read_master(spark, path).collect())) == sorted(map(tuple, asm.upsert(base, new, "video_name").collect()))
    asm.upsert_master(spark, path, new.limit(0), "video_name", 16)
    assert files(path) == after


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        asm.require_columns(wide(spark), ["a", "no"])
