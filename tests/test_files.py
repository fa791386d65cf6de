"""Large files in the form they come in."""

import json
import random

import pytest
from pyspark.sql import functions as F

from setgauge.sources import frames as frame_files


def written(path, frames, indent=None):
    path.write_text(json.dumps(frames, indent=indent))  # NaN as the word


def frames_of(n, seed=1):
    rng = random.Random(seed)
    value = lambda: float("nan") if rng.random() < 0.1 else round(rng.random() * 500, 3)
    return [{"frame_index": i, "people": [] if i % 7 == 3 else [{"keypoints": [[value(), value()] for _ in range(16 if i % 5 else 3)]}]} for i in range(n)]


def rows(df):
    return sorted((r["set_id"], r["frame_index"], r["joint"], r["x"], r["y"]) for r in df.select("set_id", "frame_index", "joint", F.coalesce("x", F.lit(-1.0)).alias("x"), F.coalesce("y", F.lit(-1.0)).alias("y")).collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, indent):
    written(tmp_path / "Squat 1_keypoints.json", frames_of(3000), indent)
    written(tmp_path / "Bench 2_keypoints.json", frames_of(1, 2), indent)
    written(tmp_path / "Empty 3_keypoints.json", [], indent)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        got = frame_files.read_keypoint_arrays(spark, str(tmp_path))
        tasks = got.groupBy(F.spark_partition_id().alias("task")).count().count()
        assert tasks >= 10 and rows(got) == rows(frame_files.read_keypoints(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_frames_in_another_form_are_an_error(spark, tmp_path):
    written(tmp_path / "x_keypoints.json", [{"people": [], "frame_index": 0}, {"people": [], "frame_index": 1}])
    with pytest.raises(Exception, match="(?i)malformed"):
        frame_files.read_keypoint_arrays(spark, str(tmp_path)).collect()
