"""Known values, rule properties and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from setgauge.functions import boxes, keys, labels, numbers
from setgauge.operators import assemble, features, impute, model, pose_cleaning, posture, reports
from setgauge.session import fresh_path
from setgauge.sources import frames as frame_files
from setgauge.sources import logs, tables

# Drops of one judged set, and one saved repetition report.
DROPS = [0.285, 0.347, 0.441, 0.307, 0.453, 0.240, 0.132, 0.515, 0.213, 0.127, 0.007, 0.207]
REPORT = """Video: Squat 318
Movement: Broom
Rep pattern: TBT
Detected reps: 8

Rep 1: 2.63 seconds
Rep 2: 0.90 seconds
Rep 3: 0.90 seconds
Rep 4: 1.00 seconds
Rep 5: 2.93 seconds
Rep 6: 1.07 seconds
Rep 7: 2.67 seconds
Rep 8: 0.67 seconds

Fatigue (Last - First): -1.97s
"""
LOG = """Squat 1 --- DEBUG
Squat 1 KEEP Rep 0: frames 4->49 (45 frames)
Squat 1 RESULT
Squat 1 First rep: (4, 49)
Squat 1 Last rep : (49, 97)
Squat 1 D value  : 0.5196114778518677
Squat 2 SKIP: only 0 valid rep(s) detected.
Squat 3 RESULT
Squat 3 First rep: (1, 2)
Squat 3 Last rep : (3, 4)
"""


def test_shallow_reps(spark):
    rows = [(0, i, i, i + 1, d) for i, d in enumerate(DROPS)]
    df = spark.createDataFrame(rows, "set_id int, pos long, start_idx long, end_idx long, drop double")
    judged = posture.keep_deep_reps(df, posture.SQUAT).collect()
    assert judged[0]["threshold"] == pytest.approx(0.2575)
    assert sorted(r["pos"] for r in judged if r["kept"]) == [0, 1, 2, 3, 4, 7]


def test_rep_report(spark):
    df = spark.createDataFrame([(REPORT,)], "value string")
    row = logs.parse_rep_reports(df).first()
    assert (row["video_name"], row["pattern"], row["rep_count"], row["fatigue_s"]) == ("Squat 318", "TBT", 8, -1.97)
    assert row["durations_s"] == [2.63, 0.9, 0.9, 1.0, 2.93, 1.07, 2.67, 0.67]


def test_posture_log(spark, tmp_path):
    (tmp_path / "squat.txt").write_text(LOG)
    lines = logs.read_log_lines(spark, str(tmp_path))
    rows = logs.parse_posture_log(lines, F.lit("squat")).collect()
    assert [(r["video_name"], r["last_rep_end"]) for r in rows] == [("Squat 1", 97)]
    assert rows[0]["d_value"] == pytest.approx(0.5196114778518677)
    assert [tuple(r) for r in logs.skipped_sets(lines).collect()] == [("Squat 2", "only 0 valid rep(s) detected.")]


def test_keypoint_json(spark, tmp_path):
    good = "[" + ",".join(f"[{i}, {i + 0.5}]" for i in range(15)) + ",[NaN, 3.0]]"
    text = f'[{{"frame_index": 2, "people": []}}, {{"frame_index": 0, "people": [{{"keypoints": {good}}}]}}, '
    text += '{"frame_index": 1, "people": [{"keypoints": [[1.0, 2.0]]}]}]'
    (tmp_path / "Squat 5_keypoints.json").write_text(text)
    rows = frame_files.read_keypoints(spark, str(tmp_path)).orderBy("frame_index", "joint").collect()
    assert len(rows) == 48 and rows[0]["set_id"] == "Squat 5"
    assert (rows[3]["x"], rows[3]["y"]) == (3.0, 3.5)
    assert rows[15]["x"] is None and rows[15]["y"] == 3.0
    assert all(r["x"] is None for r in rows[16:])


def test_padded_au_header(spark, tmp_path):
    (tmp_path / "Squat 9_pose_guided.csv").write_text("frame, timestamp, success, confidence, AU04_r, extra\n1, 0.1, 1, 0.9, 2.5, 7\n")
    row = frame_files.read_au_frames(spark, str(tmp_path)).first()
    assert (row["set_id"], row["success"], row["AU04_r"]) == ("Squat 9", 1, 2.5)
    assert "extra" not in row.asDict()


def test_history_round_trip(spark):
    path = fresh_path(spark, "history")
    rows = [("1_a", "2026-03-15T21:08:13.872297+00:00", "Squat", 6.0, 0.34, "a.mp4")]
    made = spark.createDataFrame(rows, "id string, timestamp string, lift_type string, predicted_rpe double, confidence double, video_name string")
    for _ in range(2):
        tables.append_history(made.withColumn("timestamp", F.to_timestamp("timestamp")), path)
    assert tables.read_history_lines(spark, path).count() == 2
    assert tables.clear_history(spark, path) == 2
    assert tables.read_history_lines(spark, path).count() == 0


def test_label_columns(spark):
    named = spark.createDataFrame([("Bench Press 1", 7.5)], ["Set", "RPE"])
    assert tuple(tables.label_rows(named).first()) == ("Bench Press 1.mp4", "bench_press", 7.5)
    with pytest.raises(ValueError):
        tables.label_rows(spark.createDataFrame([(1,)], ["RPE"]))
    with pytest.raises(ValueError):
        tables.label_rows(spark.createDataFrame([("a",)], ["Video"]))


def test_required_columns(spark):
    with pytest.raises(ValueError):
        assemble.require_columns(spark.range(1), ["id", "rep_count"])


def test_iou_properties(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(float(v) for v in r) for r in rng.integers(0, 20, (200, 8))]
    df = spark.createDataFrame(rows, [f"c{i}" for i in range(8)])
    p = boxes.corners(F.array(*[F.col(f"c{i}") for i in range(4)]))
    q = boxes.corners(F.array(*[F.col(f"c{i}") for i in range(4, 8)]))
    for a, b in df.select(p.alias("p"), q.alias("q")).select(boxes.iou(F.col("p"), F.col("q")), boxes.iou(F.col("q"), F.col("p"))).collect():
        assert a == b and 0.0 <= a <= 1.0


def test_half_even(spark):
    df = spark.createDataFrame([(6.25,), (6.75,), (7.25,), (7.3,)], ["x"])
    assert [r[0] for r in df.select(numbers.half_point(F.col("x"))).collect()] == [6.0, 7.0, 7.0, 7.5]


def test_names(spark):
    df = spark.createDataFrame([("a.b.mp4",), (".hidden",), (None,), (" Squat 12.mp4 ",)], "f string")
    assert [r[0] for r in df.select(keys.file_stem(F.col("f"))).collect()] == ["a.b", ".hidden", "", "Squat 12"]
    assert [r[0] for r in df.select(keys.first_number(F.col("f"))).collect()] == [4, 10**9, 10**9, 12]


def test_limits():
    assert [reports.safe_limit(v) for v in (None, 0, -3, 7, 9999)] == [50, 50, 1, 7, 500]


def test_target_bins(spark):
    df = spark.createDataFrame([(5.0,), (5.5,), (9.0,), (10.0,), (0.0,)], ["y"])
    assert [r[0] for r in df.select(model.target_bin(F.col("y"))).collect()] == [0, 1, 2, 3, None]


def test_folds_are_balanced_and_complete(spark):
    df = spark.range(1000).withColumn("rpe", (F.col("id") % 19) / 2.0 + 1)
    folded = model.with_folds(df, "id", "rpe")
    sizes = folded.groupBy(model.target_bin(F.col("rpe")).alias("b"), "fold").count().collect()
    for b in range(4):
        counts = [r["count"] for r in sizes if r["b"] == b]
        assert max(counts) - min(counts) <= 1
    assert folded.count() == 1000


def test_split_shares(spark):
    parts = model.with_split(spark.range(1000), "id", {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("part").count()
    assert {r["part"]: r["count"] for r in parts.collect()} == {"train": 700, "validation": 150, "test": 150}


def test_serving_with_any_part_missing(spark):
    au = ", ".join(f"{a} double" for a in features.AU_MAX_COLUMNS)
    schema = f"set_id int, has_bar boolean, has_face boolean, has_posture boolean, rep_count int, rep_change_s double, d_value double, posture_reps int, movement string, detection_rate double, confidence_mean double, confidence_std double, confidence_min double, {au}"
    rows = []
    for i in range(8):
        bar, face, post = bool(i & 1), bool(i & 2), bool(i & 4)
        rows.append(
            (i, bar, face, post, 4 if bar else None, 0.5 if bar else None, 1.5 if post else None, 3 if post else None, "Squat")
            + ((0.9, 0.8, 0.05, 0.4) if face else (None,) * 4)
            + ((2.5,) * 10 if face else (None,) * 10)
        )
    served = features.serving_features(spark.createDataFrame(rows, schema))
    out = {r["set_id"]: r for r in assemble.align_features(served, features.MODEL_FEATURES).collect()}
    assert all(v is not None for r in out.values() for v in r)
    assert out[0]["detection_rate"] == 0.5 and out[0]["rep_count"] == 0.0
    assert out[4]["rep_count"] == 3.0 and out[5]["rep_count"] == 4.0
    assert out[2]["au_highly_active_count"] == 10.0
    assert len(features.MODEL_FEATURES) == 41


def test_imputation_leaves_good_rows(spark):
    feats = spark.createDataFrame(
        [("a.mp4", None, 1.0), ("b.mp4", None, 3.0), ("c.mp4", "bad", None), ("d.mp4", "bad", None), ("e.mp4", None, 9.0), ("f.mp4", "bad", None)],
        "video_name string, error string, AU04_max double",
    )
    tags = spark.createDataFrame(
        [("a.mp4", "squat", 7.0), ("b.mp4", "squat", 7.0), ("c.mp4", "squat", 7.0), ("e.mp4", "deadlift", 8.0), ("f.mp4", "squat", 8.0)],
        "video_name string, exercise_type string, rpe double",
    )
    out = {r["video_name"]: r for r in impute.impute_by_group_mean(feats, tags).collect()}
    assert (out["a.mp4"]["AU04_max"], out["a.mp4"]["imputed"]) == (1.0, False)
    assert (out["c.mp4"]["AU04_max"], out["c.mp4"]["imputation_method"]) == (2.0, "squat + RPE=7.0")
    assert out["d.mp4"]["error"] == "bad" and not out["d.mp4"]["imputed"]
    assert (out["f.mp4"]["AU04_max"], out["f.mp4"]["imputation_method"]) == (9.0, "RPE=8.0 (any exercise)")


def test_status_edges(spark):
    df = spark.createDataFrame([(3, 0.2, 0.8, 0.75, 0.7), (0, 0.1, 1.4, None, None), (2, None, None, 0.5, 0.5)], "r int, f double, d double, p double, c double")
    got = df.select(
        labels.bar_status(F.col("r"), F.col("f")), labels.posture_status(F.col("d")), labels.face_status(F.col("p"), F.col("c"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Stable Tempo", "Form Drift", "Strong Face Tracking"),
        ("Unavailable", "High Deviation", "No Face Data"),
        ("Detected", "Unavailable", "Partial Face Tracking"),
    ]


def test_model_bundle_versions(spark):
    rows = [(i, float(i % 10 + 1), float(i % 10), float(i % 3)) for i in range(80)]
    df = spark.createDataFrame(rows, ["set_id", "rpe", "u", "v"])
    quick = model.Booster("squared", rounds=2, depth=2, bins=8)
    fitted = model.fit_blend(df, "rpe", ["u", "v"], quick, quick)
    folder = fresh_path(spark, "bundles")
    for version in ("20260101_000000", "20260102_000000"):
        model.save_bundle(fitted, folder, version, spark)
    loaded = model.load_bundle(folder, spark)
    assert loaded.metadata["version"] == "20260102_000000"
    a = [r[0] for r in fitted.predict(df).orderBy("set_id").select("prediction").collect()]
    assert a == [r[0] for r in loaded.predict(df).orderBy("set_id").select("prediction").collect()]
    assert model.load_bundle(folder, spark, "20260101_000000").metadata["version"] == "20260101_000000"


def test_profiles_differ_as_stated():
    assert pose_cleaning.BENCH_V2_CLEANING.max_missing == 15
    assert posture.PROFILES["Deadlift"].signal_frame == "raw_scaled"
