"""Averages for every alpha, the shared folder, streams that lose nothing, readers by header."""

import math

import pytest
from pyspark.sql import functions as F

from setgauge import session
from setgauge.operators import reps, signals
from setgauge.sources.frames import read_au_frames
from setgauge.streaming import pose_stream


@pytest.mark.parametrize("alpha", [0.001, 0.03, 0.28, 0.5, 0.9, 0.99999, 1.0])
def test_average_for_every_alpha(spark, alpha):
    n = 2500
    df = spark.range(n).select(F.lit(1).alias("set_id"), F.col("id").alias("pos"), (F.sin("id") * 1e10).alias("y"))
    got = [r["z"] for r in signals.ema_signal(df, "y", "z", alpha, grid_bits=None).orderBy("pos").collect()]
    want = None
    for i, value in enumerate(got):
        x = math.sin(i) * 1e10
        want = x if want is None else alpha * x + (1 - alpha) * want
        assert abs(value - want) <= 1e-3


def test_bad_alpha():
    for alpha in (0, -0.1, 1.1):
        with pytest.raises(ValueError):
            signals.ema_reach(alpha)


class Unset:
    """A session that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        getCheckpointDir = staticmethod(lambda: None)


def test_no_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.fresh_path(Unset, "x")


def test_scratch_removes_what_was_written(spark):
    with session.scratch(spark):
        kept = session.cut_lineage(spark.range(5), "scratch_test")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 5
    assert not pose_stream.exists(spark, path)


def test_distance_goes_by_each_sets_rate(spark):
    wave = lambda i, period: math.cos(2 * math.pi * i / period) * 50
    rows = [(s, i, wave(i, period), fps, 0) for s, period, fps in ((1, 30, 60.0), (2, 30, 30.0), (3, 20, 60.0)) for i in range(300)]
    trace = spark.createDataFrame(rows, "set_id long, pos long, y double, fps double, lift_code int")
    counts = {r["set_id"]: r["n"] for r in reps.bar_reps(trace).groupBy("set_id").agg(F.count("*").alias("n")).collect()}
    assert counts[1] >= 8 and counts[2] >= 8
    assert counts.get(3, 0) <= 8  # peaks 20 frames apart are too near at 60 frames a second


def test_headers_by_name(spark, tmp_path):
    def write(name, header, *rows):
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *rows]) + "\n")

    write("a", "frame, success, AU04_r, AU06_r", "0, 1, 0.5, 2.5", "1, 0, 0.25, 2.0")
    write("b c", "AU06_r, AU04_r, frame", "3.5, 1.5, 7")
    got = read_au_frames(spark, str(tmp_path), columns=None)
    rows = {(r["set_id"], r["frame"]): (r["success"], r["AU04_r"], r["AU06_r"]) for r in got.collect()}
    assert rows == {("a", 0): (1, 0.5, 2.5), ("a", 1): (0, 0.25, 2.0), ("b c", 7): (1, 1.5, 3.5)}
    assert read_au_frames(spark, str(tmp_path), columns=None, only_success=True).count() == 2
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        read_au_frames(spark, str(tmp_path / "empty"))


def test_history_takes_late_and_repeated_records(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    stamp = F.timestamp_seconds(F.col("id") * 86400)
    for low, high in ((50, 60), (40, 55), (0, 10)):
        spark.range(low, high).withColumn("timestamp", stamp).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, timestamp timestamp").parquet(source)
        pose_stream.append_history_stream(stream, out, marks)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [*range(10), *range(40, 60)]


def test_sets_over_many_files(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.range(400).select((F.col("id") % 3).alias("set_id"), "id").repartition(9).write.parquet(source)
    work = lambda df: df.groupBy("set_id").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    for _ in range(2):
        pose_stream.process_new_files(spark, source, spark.read.parquet(source).schema, work, out, marks, files=2)
    got = {r["set_id"]: (r["n"], r["s"]) for r in pose_stream.latest(spark, out).collect()}
    assert got == {s: (len(range(s, 400, 3)), sum(range(s, 400, 3))) for s in range(3)}
