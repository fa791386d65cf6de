"""Streams that read only what is new, and frames that arrive out of order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tracks import CANDS, PROFILES, pose_rows

from setgauge.operators import carry, facial, pose_cleaning, tracks
from setgauge.streaming import ordered_poses, pose_stream, set_states


def au_rows(n, sets, seed=1):
    rng = random.Random(seed)
    values = lambda: [None if rng.random() < 0.1 else rng.random() * 5 for _ in facial.INTENSITY]
    return [(i % sets, i // sets, rng.choice([0, 1, 1]), None if rng.random() < 0.1 else 1e6 + rng.random(), *values()) for i in range(n)]


SCHEMA = "set_id long, frame long, success int, confidence double, " + ", ".join(f"{c} double" for c in facial.INTENSITY)


def summary(df):
    return {r["set_id"]: r.asDict() for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            other = got[key][name]
            assert value is None and other is None or math.isclose(other, value, rel_tol=1e-6, abs_tol=1e-6), (key, name, other, value)


def test_merged_states_equal_one_pass(spark):
    frames = spark.createDataFrame(au_rows(900, 4) + [(9, 0, 1, 0.5, *[1.0] * 10), (10, 0, 0, None, *[None] * 10)], SCHEMA)
    parts = [facial.facial_states(frames.filter(F.col("frame") % 5 == k)) for k in range(5)]
    states = parts[0]
    for part in parts[1:]:
        states = states.unionByName(part)
    want = summary(facial.facial_summary(frames, with_error=False))
    same(summary(facial.summary_of_states(facial.merged_states(states))), want)
    assert want[9]["confidence_std"] is None and want[10]["detection_count"] == 0  # one valid frame, and none


def test_batches_read_only_their_own_files(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    states = set_states.SetStates(spark, out, facial.merged_states, fold=3)
    every, read = [], []
    for batch in range(10):  # the same sets again and again
        rows = au_rows(120, 5, batch)
        every += rows
        frames = spark.createDataFrame(rows, SCHEMA)
        frames.coalesce(1).write.mode("append").parquet(source)
        read += set_states.process_new_files(spark, source, frames.schema, facial.facial_states, states, marks)
        upto, later = states.tables()
        assert len(later) < 3 and sum(spark.read.parquet(p).count() for p in states.paths()) <= 15
    assert read == [120] * 10  # not more as the source grows
    assert set_states.process_new_files(spark, source, frames.schema, facial.facial_states, states, marks) == []
    same(summary(facial.summary_of_states(states.current())), summary(facial.facial_summary(spark.createDataFrame(every, SCHEMA), with_error=False)))


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    states = set_states.SetStates(spark, str(tmp_path / "out"), facial.merged_states, fold=2)
    with pytest.raises(FileNotFoundError):
        states.current()
    parts = [spark.createDataFrame(au_rows(60, 3, k), SCHEMA) for k in range(3)]
    for batch in (0, 0, 1, 1, 0, 2, 2):  # 0 and 1 also after they were merged
        states.add(facial.facial_states(parts[batch]), batch)
    whole = parts[0].union(parts[1]).union(parts[2])
    same(summary(facial.summary_of_states(states.current())), summary(facial.facial_summary(whole, with_error=False)))


def test_history_batches_read_only_new_records(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    stamp = F.timestamp_seconds(F.col("id") * 86400)
    read = []
    for k in range(10):  # each delivery repeats half of the one before
        spark.range(k * 20, k * 20 + 40).withColumn("timestamp", stamp).coalesce(1).write.mode("append").parquet(source)
        read += pose_stream.append_history_stream(spark.readStream.schema("id long, timestamp timestamp").parquet(source), out, marks)
    assert read == [40] * 10
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(220))


def test_history_forgets_old_ids(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    stamp = F.timestamp_seconds((F.col("id") + 1) * 86400)
    for low, high in ((0, 10), (5, 10), (9, 40), (38, 41), (0, 3)):  # the last ones are long past
        spark.range(low, high).withColumn("timestamp", stamp).coalesce(1).write.mode("append").parquet(source)
        pose_stream.append_history_stream(spark.readStream.schema("id long, timestamp timestamp").parquet(source), out, marks, forget="5 days")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(41))


def batch_poses(frames, profile):
    placed = tracks.frame_positions(frames.drop("taken"))
    return carry.carried_fold(placed, lambda: pose_cleaning.PoseCleaner(profile), pose_cleaning.POSE_OUTPUT)


def poses(df):
    key = ["set_id", "frame_index", "x", "y", "used"]
    return sorted(map(str, df.select(*key).collect()))


def test_frames_in_any_order_equal_batch(spark, tmp_path):
    """Two sets with lost frames, dealt over files at random, one file sent twice."""
    rows = [r for r in pose_rows(60) if r[1] % 17 != 5] + [(7, *r[1:]) for r in pose_rows(40) if r[1] not in (0, 20, 21)]
    frames = spark.createDataFrame(rows, CANDS).withColumn("taken", F.timestamp_seconds(1_600_000_000 + F.col("frame_index") / 30))
    path = str(tmp_path / "in")
    for part in range(4):
        frames.filter(F.pmod(F.hash("frame_index", "set_id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(path)
    frames.filter(F.pmod(F.hash("frame_index", "set_id"), F.lit(4)) == 2).coalesce(1).write.mode("append").parquet(path)
    profile = PROFILES["bench_v2"]
    got = ordered_poses.run_ordered(spark, path, frames.schema, profile, files=1, delay="1 hour")
    assert poses(got) == poses(batch_poses(frames, profile))


def test_watermark_gives_up_on_lost_frames(spark, tmp_path):
    """Frames behind a gap are cleaned once the watermark has passed them, without closing; a set starts from its given pose."""
    rows = [r for r in pose_rows(50) if r[1] != 10]
    frames = spark.createDataFrame(rows, CANDS).withColumn("taken", F.timestamp_seconds(1_600_000_000 + F.col("frame_index")))
    path, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    stream = lambda: ordered_poses.clean_ordered(spark.readStream.schema(frames.schema).parquet(path), PROFILES["bench_v2"], delay="5 seconds")
    with ordered_poses.rocks(spark):
        frames.filter("frame_index < 30").coalesce(1).write.mode("append").parquet(path)
        pose_stream.drain(stream(), out, marks)
        seen = {r["frame_index"] for r in spark.read.parquet(out).collect()}
        known = {r[1] for r in rows}
        assert seen >= {i for i in known if i <= 24}  # the watermark stands at 24 seconds
        frames.filter("frame_index >= 30").coalesce(1).write.mode("append").parquet(path)
        pose_stream.drain(stream(), out, marks)
    got = {r["frame_index"]: r for r in spark.read.parquet(out).collect()}
    want = {r["frame_index"]: r for r in batch_poses(frames, PROFILES["bench_v2"]).collect()}
    assert got.keys() >= {i for i in known if i <= 44}
    for i, row in got.items():
        np.testing.assert_allclose(np.array([row["x"], row["y"]], float), np.array([want[i]["x"], want[i]["y"]], float))
