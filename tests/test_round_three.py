"""Small rows of the test's own for faults that round three found."""

import math
import statistics

import numpy as np
from pyspark.sql.types import IntegerType

from setgauge.operators import facial
from setgauge.operators.quantiles import wide_percentiles
from setgauge.sources import logs
from setgauge.sources.frames import read_keypoint_lines


def test_described_columns(spark):
    """Quartiles of every column, also for a set without values, one with a null and rows without a set."""
    rows = [(1, 0, 3.0, -1.0), (1, 1, 1.0, None), (1, 2, 8.0, 4.0), (1, 3, 2.0, 0.5), (2, 0, None, 7.0), (None, None, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "set_id long, frame long, a double, b double")
    got = {(r["set_id"], r["metric"]): r for r in facial.describe_columns(df, ["a", "b"]).collect()}
    assert sorted(got, key=str) == sorted(((s, c) for s in (1, 2, None) for c in "ab"), key=str)
    for (s, c), r in got.items():
        values = sorted(x[2 + "ab".index(c)] for x in rows if x[0] == s and x[2 + "ab".index(c)] is not None)
        assert r["count"] == len(values)
        if not values:
            assert [r[n] for n in ("mean", "std", "min", "p25", "p50", "p75", "max")] == [None] * 7
            continue
        assert (r["min"], r["max"]) == (values[0], values[-1]) and math.isclose(r["mean"], statistics.mean(values))
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            place = p * (len(values) - 1)
            low = values[int(place)]
            high = values[min(int(place) + 1, len(values) - 1)]
            assert math.isclose(r[name], low + (high - low) * (place - int(place)))


def test_reports_many_to_a_file(spark, tmp_path):
    """The same rows from files of many reports as from one file per report, and far fewer files."""
    rows = [(f"Squat {i}", k, 0.5 * k + i / 100, "TBT", "Squat") for i in range(300) for k in range(1, 1 + i % 4)]
    texts = logs.rep_report_text(spark.createDataFrame(rows, "set_id string, rep_no int, duration_s double, pattern string, movement string"))
    one = [r["value"] for r in texts.collect()]
    for i, text in enumerate(one):
        (tmp_path / f"r{i}.txt").write_text(text)
    path = str(tmp_path / "many")
    logs.write_rep_reports(texts.repartition(3), path)
    assert len(list((tmp_path / "many").glob("part-*"))) == 3
    got = logs.read_rep_reports(spark, path, logs.REPORT_END)
    assert got.count() == len(one) == 225
    assert sorted(map(repr, got.collect())) == sorted(map(repr, logs.read_rep_reports(spark, f"{tmp_path}/r*.txt").collect()))


def test_keypoint_lines(spark, tmp_path):
    """Frames of many sets in one file; a frame without people and a missing joint give nulls."""
    pairs = [[float(j), None if j == 3 else j / 2] for j in range(16)]
    frames = [(s, f, [] if f == 1 else [([[x, float("nan") if y is None else y] for x, y in pairs],)]) for s in (-1, 0, 7) for f in (0, 1)]
    schema = "set_id int, frame_index int, people array<struct<keypoints: array<array<double>>>>"
    spark.createDataFrame(frames, schema).coalesce(1).write.json(f"{tmp_path}/k")
    got = {(r["set_id"], r["frame_index"], r["joint"]): (r["x"], r["y"]) for r in read_keypoint_lines(spark, f"{tmp_path}/k", IntegerType()).collect()}
    assert got == {(s, f, j): (None, None) if f == 1 else tuple(pairs[j]) for s in (-1, 0, 7) for f in (0, 1) for j in range(16)}


def test_percentiles_without_blocks(spark):
    """Bins of one value and of several, both signs, a column without values in a set."""
    rng = np.random.default_rng(5)
    steps = rng.integers(-6, 7, 900) / 4
    dense = 1000 + rng.random(900) / 8  # all in one bin
    rows = [(i % 3, float(steps[i]), float(dense[i]) if i % 3 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "set_id long, a double, b double").repartition(5)
    probs = {"q10": 0.1, "median": 0.5, "q90": 0.9}
    got = {(r["set_id"], r["c"]): r for r in wide_percentiles(df, "set_id", ["a", "b"], probs).collect()}
    assert sorted(got) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)]
    for (s, c), r in got.items():
        values = [x[1 + c] for x in rows if x[0] == s]
        for name, p in probs.items():
            assert math.isclose(r[name], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12)
