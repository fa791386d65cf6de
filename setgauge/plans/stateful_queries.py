"""Sequential pose cleaning, lifter tracking and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded as r6
from ..operators import facial
from ..operators import pose_cleaning as pc
from ..session import cut_lineage, fresh_path
from ..streaming import ordered_poses as op
from ..streaming import pose_stream as ps
from ..streaming import set_states
from . import fixtures as fx
from .fixtures import cte
from .posture_queries import PIXELS, _described, _person_boxes, _pixels
from .registry import query
from .set_queries import AU_MAX, AU_ROUNDED, DETECTION, DETECTION_OUT, FACE_STATS, with_steps


def _cleaned(spark, sf, profile, score="cand_score"):
    frames = fx.pose_joint(spark, sf).select("set_id", "frame_index").distinct()
    out = pc.clean_poses(_described(spark, sf), profile, frames=frames, score=score)
    return out.select("set_id", "frame_index", "used", F.posexplode(F.arrays_zip("x", "y")).alias("joint", "p")).select(
        "set_id", "frame_index", "used", "joint", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y")
    )


@query("cleaned_poses_squat__T1")
def cleaned_poses_squat(spark, sf):
    return _cleaned(spark, sf, pc.SQUAT_CLEANING)


@query("cleaned_poses_bench__T4_T5")
def cleaned_poses_bench(spark, sf):
    return _cleaned(spark, sf, pc.BENCH_CLEANING)


@query("cleaned_poses_bench_v2__T3_T4_T5")
def cleaned_poses_bench_v2(spark, sf):
    return _cleaned(spark, sf, pc.BENCH_V2_CLEANING.with_(min_size=0.1), "cand_score_sized")


TRACK = cte("pose_joint", extra=PIXELS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
valued AS (SELECT set_id, frame_index, max({'v': greatest(1.0, (x2 - x1) * (y2 - y1)), 'np': -person, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) AS b
  FROM extent WHERE frame_index = 0 GROUP BY set_id, frame_index),
followed AS (SELECT set_id, frame_index, b FROM valued
  UNION ALL
  SELECT t.set_id, t.frame_index + 1, max({'v':
    greatest(0.0, least(e.x2, t.b.x2) - greatest(e.x1, t.b.x1)) * greatest(0.0, least(e.y2, t.b.y2) - greatest(e.y1, t.b.y1))
    / ((e.x2 - e.x1) * (e.y2 - e.y1) + (t.b.x2 - t.b.x1) * (t.b.y2 - t.b.y1)
       - greatest(0.0, least(e.x2, t.b.x2) - greatest(e.x1, t.b.x1)) * greatest(0.0, least(e.y2, t.b.y2) - greatest(e.y1, t.b.y1))),
    'np': -e.person, 'x1': e.x1, 'y1': e.y1, 'x2': e.x2, 'y2': e.y2})
  FROM followed t JOIN extent e ON e.set_id = t.set_id AND e.frame_index = t.frame_index + 1 GROUP BY t.set_id, t.frame_index)
SELECT set_id, frame_index, -b.np AS person, round(b.v, 4) + 0.0 AS rank_value FROM followed"""


@query("lifter_track__T2", TRACK)
def lifter_track(spark, sf):
    out = pc.follow_lifter(_person_boxes(spark, sf))
    return out.select("set_id", "frame_index", "person", r6(F.col("rank_value"), 4).alias("rank_value"))


RESEED = PIXELS | {
    "trace": """SELECT set_id, frame_index AS pos, CASE WHEN score >= 0.2 THEN x END AS x, CASE WHEN score >= 0.2 THEN y END AS y
  FROM pixels WHERE person = 0 AND joint = 8""",
    "wrists": "SELECT set_id, frame_index AS pos, x AS wx, y AS wy FROM pixels WHERE person = 0 AND joint = 9 AND score >= 0.35 AND x IS NOT NULL",
    "lost": """SELECT *, pos - coalesce(last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS)
  OVER (PARTITION BY set_id ORDER BY pos), 0) AS lost FROM trace""",
    "due": """SELECT l.*, wx, wy, pos > 0 AND (pos % 12 = 0 OR lost >= 2) AND wy IS NOT NULL
  AND NOT (y IS NOT NULL AND coalesce(sqrt(pow(wx - x, 2) + pow(wy - y, 2)) > 120, false) AND lost < 2) AS take
  FROM lost l LEFT JOIN wrists USING (set_id, pos)""",
}


@query(
    "reseeded_trace__T6",
    cte("pose_joint", extra=RESEED)
    + """ SELECT set_id, pos, round(CASE WHEN take THEN wx ELSE x END, 6) + 0.0 AS x, round(CASE WHEN take THEN wy ELSE y END, 6) + 0.0 AS y,
  take AS reseeded FROM due""",
)
def reseeded_trace(spark, sf):
    one = _pixels(spark, sf).filter("person = 0").withColumn("pos", F.col("frame_index").cast("long"))
    seen = F.col("score") >= 0.2
    trace = one.filter("joint = 8").select("set_id", "pos", F.when(seen, F.col("x")).alias("x"), F.when(seen, F.col("y")).alias("y"))
    wrists = one.filter("joint = 9 AND score >= 0.35 AND x IS NOT NULL").select(
        "set_id", "pos", F.col("x").alias("wx"), F.col("y").alias("wy")
    )
    out = pc.reseed_trace(trace, wrists)
    return out.select("set_id", "pos", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "reseeded")


SLABS = 4


@query("streamed_clean_poses__T1")
def streamed_clean_poses(spark, sf):
    described = cut_lineage(_described(spark, sf), "described")
    frames = cut_lineage(pc.candidate_frames(described).drop("pos"), "frames")
    path = fresh_path(spark, "candidate_frames")
    last = frames.agg(F.max("frame_index")).first()[0] or 0
    width = last // SLABS + 1
    for slab in range(SLABS):  # recorded one after the other, so files of later frames are newer
        frames.filter(F.floor(F.col("frame_index") / width) == slab).repartition("set_id").write.mode("append").parquet(path)
    initial = cut_lineage(pc.bootstrap_states(described, pc.SQUAT_CLEANING), "start_states")  # read by every micro-batch
    out = ps.run_clean_poses(spark, path, frames.schema, pc.SQUAT_CLEANING, files=3, initial=initial)
    return out.select("set_id", "frame_index", F.posexplode(F.arrays_zip("x", "y")).alias("joint", "p")).select(
        "set_id", "frame_index", "joint", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y")
    )


@query("reordered_clean_poses__T1")
def reordered_clean_poses(spark, sf):
    """Files that each hold every third frame, so most frames come before their predecessors."""
    described = cut_lineage(_described(spark, sf), "described")
    frames = cut_lineage(pc.candidate_frames(described).drop("pos").withColumn("taken", F.timestamp_seconds(1_600_000_000 + F.col("frame_index") / 30)), "timed_frames")
    path = fresh_path(spark, "mixed_frames")
    for part in (2, 0, 1):
        frames.filter(F.col("frame_index") % 3 == part).repartition(2, "set_id").write.mode("append").parquet(path)
    initial = cut_lineage(pc.bootstrap_states(described, pc.SQUAT_CLEANING), "start_states")
    out = op.run_ordered(spark, path, frames.schema, pc.SQUAT_CLEANING, files=2, initial=initial, delay="1 day")
    return out.select("set_id", "frame_index", F.posexplode(F.arrays_zip("x", "y")).alias("joint", "p")).select(
        "set_id", "frame_index", "joint", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y")
    )


@query(
    "incremental_facial_features__T7",
    with_steps(DETECTION, f"SELECT set_id, {DETECTION_OUT}, {AU_ROUNDED}, au_highly_active_count FROM face", "au_frame"),
)
def incremental_facial_features(spark, sf):
    path, out, marks = (fresh_path(spark, n) for n in ("new_frames", "face_states", "face_marks"))
    frames = fx.au_frame(spark, sf, frames=False)
    frames.repartition(12).write.parquet(path)  # every set is in many files
    states = set_states.SetStates(spark, out, facial.merged_states, fold=2)
    for _ in range(2):  # the second run finds nothing new
        set_states.process_new_files(spark, path, frames.schema, facial.facial_states, states, marks, files=5)
    summary = facial.summary_of_states(states.current())
    return summary.select("set_id", "detection_count", "total_frames", *[r6(F.col(c)).alias(c) for c in (*FACE_STATS, *AU_MAX)], "au_highly_active_count")


@query(
    "streamed_history__T8",
    cte("history") + " SELECT id, lift_type, predicted_rpe FROM history",
)
def streamed_history(spark, sf):
    source, out, marks = (fresh_path(spark, n) for n in ("records", "history", "history_marks"))
    past = fx.history(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    newer, older = past.filter("id % 2 = 0"), past.filter("id % 2 = 1")
    for sent in (newer.unionByName(newer.filter("id % 3 = 0")), older.unionByName(newer.filter("id % 5 = 0"))):
        sent.write.mode("append").parquet(source)  # the second delivery is older, and repeats records
        ps.append_history_stream(spark.readStream.schema(past.schema).parquet(source), out, marks)
    return spark.read.parquet(out).select("id", "lift_type", "predicted_rpe")
