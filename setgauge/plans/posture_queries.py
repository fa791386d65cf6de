"""Posture drift, joint motion and person-candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.numbers import rounded as r6
from ..operators import candidates as cd
from ..operators import posture, signals
from . import fixtures as fx
from .fixtures import cte
from .registry import query
from .signal_queries import thin_sql, tops_sql

PROFILE = posture.SQUAT.with_(min_rep_frames=4)
WIDTH, HEIGHT = 640.0, 480.0

# --- shared SQL steps ----------------------------------------------------------


def norm_sql(a: int, b: int) -> dict[str, str]:
    pick = ", ".join(
        f"max({c}) FILTER (WHERE joint = {j}) AS {c}{j}" for j in sorted({4, 5, 10, 11, a, b}) for c in ("x", "y")
    )
    return {
        "first_person": "SELECT set_id, frame_index AS pos, joint, x, y FROM pose_joint WHERE person = 0",
        "wide": f"SELECT set_id, pos, {pick} FROM first_person GROUP BY set_id, pos",
        "widths": """SELECT *, sqrt((x4 - x5) * (x4 - x5) + (y4 - y5) * (y4 - y5)) AS sw,
  sqrt((x10 - x11) * (x10 - x11) + (y10 - y11) * (y10 - y11)) AS hw FROM wide""",
        "scales": f"""SELECT set_id, pos, (x{a} + x{b}) / 2 AS ox, (y{a} + y{b}) / 2 AS oy,
  CASE WHEN sw >= 0.001 THEN sw WHEN hw IS NOT NULL THEN greatest(hw, 0.001) END AS scale FROM widths""",
        "normed": """SELECT f.set_id, f.pos, f.joint, (f.x - s.ox) / s.scale AS nx, (f.y - s.oy) / s.scale AS ny, f.y AS raw_y, s.scale
  FROM first_person f JOIN scales s USING (set_id, pos)""",
    }


def signal_sql(a: int, b: int, origin=(10, 11), raw: bool = False) -> dict[str, str]:
    value = "raw_y / scale" if raw else "ny"
    agree = f"CASE WHEN count({value}) FILTER (WHERE joint IN ({a}, {b})) = 2 THEN avg({value}) FILTER (WHERE joint IN ({a}, {b})) END"
    return norm_sql(*origin) | {"frame_signal": f"SELECT set_id, pos, {agree} AS y FROM normed GROUP BY set_id, pos"}


def reps_sql(p: posture.LiftProfile) -> dict[str, str]:
    """Repetitions, ends and drift by the rules of one lift."""
    low, high = min(p.joints), max(p.joints)
    start = signal_sql(*p.signal, p.origin, p.signal_frame == "raw_scaled") | tops_sql(p.sign, max(3, p.min_rep_frames // 2), p.prominence_share)
    return start | thin_sql("tops", p.min_rep_frames) | {
        "bottoms": "SELECT s.set_id, s.pos, s.z FROM thinned JOIN signed s USING (set_id, pos)",
        "intervals": """SELECT * FROM (SELECT set_id, pos AS start_idx, z AS bottom_z,
  lead(pos) OVER (PARTITION BY set_id ORDER BY pos) AS end_idx FROM bottoms) t WHERE end_idx IS NOT NULL""",
        "drops": """SELECT i.set_id, start_idx, end_idx, bottom_z, min(s.z) AS top_z, bottom_z - min(s.z) AS "drop"
  FROM intervals i JOIN signed s ON s.set_id = i.set_id AND s.pos BETWEEN start_idx AND end_idx
  GROUP BY i.set_id, start_idx, end_idx, bottom_z""",
        "judged": f"""SELECT *, greatest(CAST({p.min_drop} AS DOUBLE), 0.5 * max("drop") OVER (PARTITION BY set_id)) AS threshold FROM drops""",
        "ends": """SELECT f.set_id, count(start_idx) AS rep_count, min({'a': start_idx, 'b': end_idx}) AS f, max({'a': start_idx, 'b': end_idx}) AS l
  FROM (SELECT DISTINCT set_id FROM first_person) f LEFT JOIN (SELECT * FROM judged WHERE "drop" >= threshold) j USING (set_id) GROUP BY f.set_id""",
        "points": """SELECT set_id, which, k, r.a + floor(k * (r.b - r.a) / CAST(99 AS DOUBLE)) AS low,
  k * (r.b - r.a) / CAST(99 AS DOUBLE) - floor(k * (r.b - r.a) / CAST(99 AS DOUBLE)) AS share
  FROM (SELECT set_id, 'first' AS which, f AS r FROM ends WHERE rep_count >= 2
        UNION ALL SELECT set_id, 'last', l FROM ends WHERE rep_count >= 2) e, range(100) t(k)""",
        "sampled": f"""SELECT p.set_id, which, k, a.joint,
  CASE WHEN share = 0 THEN a.nx ELSE a.nx + (b.nx - a.nx) * share END AS nx,
  CASE WHEN share = 0 THEN a.ny ELSE a.ny + (b.ny - a.ny) * share END AS ny
  FROM points p JOIN normed a ON a.set_id = p.set_id AND a.pos = p.low AND a.joint BETWEEN {low} AND {high}
  LEFT JOIN normed b ON b.set_id = p.set_id AND b.pos = p.low + 1 AND b.joint = a.joint""",
        "distances": """SELECT set_id, k, joint, (f.nx - l.nx) * (f.nx - l.nx) + (f.ny - l.ny) * (f.ny - l.ny) AS d
  FROM (SELECT * FROM sampled WHERE which = 'first') f JOIN (SELECT * FROM sampled WHERE which = 'last') l USING (set_id, k, joint)""",
        "drift": """SELECT set_id, CASE WHEN count(d) = count(*) THEN sqrt(avg(d)) END AS d_value FROM distances GROUP BY set_id""",
    }


REPS = reps_sql(PROFILE)


def check(steps: dict[str, str], select: str) -> str:
    return cte("pose_joint", extra=steps) + select


def _frames(spark, sf):
    return posture.pose_frames(posture.first_person(fx.pose_joint(spark, sf)))


# --- G1..G8 ---------------------------------------------------------------------


def _normalized(spark, sf, profile):
    poses = posture.placed_poses(_frames(spark, sf), profile)
    return poses.select("set_id", "pos", F.posexplode(F.arrays_zip("nx", "ny")).alias("joint", "n")).select(
        "set_id", "pos", "joint", r6(F.col("n.nx")).alias("nx"), r6(F.col("n.ny")).alias("ny")
    )


NORMED = "SELECT set_id, pos, joint, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny FROM normed"


@query("normalized_pose_hips__G1", check(norm_sql(10, 11), NORMED))
def normalized_pose_hips(spark, sf):
    return _normalized(spark, sf, posture.SQUAT)


@query("normalized_pose_shoulders__G1", check(norm_sql(4, 5), NORMED))
def normalized_pose_shoulders(spark, sf):
    return _normalized(spark, sf, posture.BENCH)


def _signal(spark, sf, profile):
    poses = posture.placed_poses(_frames(spark, sf), profile)
    return poses.select("set_id", "pos", r6(posture.rep_signal(profile)).alias("signal"))


SIGNAL = "SELECT set_id, pos, round(y, 6) + 0.0 AS signal FROM frame_signal"


@query("rep_signal_squat__G2", check(signal_sql(4, 5), SIGNAL))
def rep_signal_squat(spark, sf):
    return _signal(spark, sf, posture.SQUAT)


@query("rep_signal_bench__G2", check(signal_sql(8, 9, origin=(4, 5)), SIGNAL))
def rep_signal_bench(spark, sf):
    return _signal(spark, sf, posture.BENCH)


@query("rep_signal_deadlift_raw__G2", check(signal_sql(10, 11, raw=True), SIGNAL))
def rep_signal_deadlift_raw(spark, sf):
    return _signal(spark, sf, posture.DEADLIFT)


@query("rep_signal_deadlift_normalized__G2", check(signal_sql(10, 11), SIGNAL))
def rep_signal_deadlift_normalized(spark, sf):
    return _signal(spark, sf, posture.DEADLIFT.with_(signal_frame="normalized"))


@query("rep_intervals__G3", check(REPS, "SELECT set_id, start_idx, end_idx FROM intervals"))
def rep_intervals(spark, sf):
    _, intervals, _ = posture.posture_steps(_frames(spark, sf), PROFILE)
    return intervals.select("set_id", "start_idx", "end_idx")


@query(
    "shallow_rep_filter__G4",
    check(
        REPS,
        """SELECT set_id, start_idx, end_idx, round("drop", 6) + 0.0 AS rep_drop, round(threshold, 6) + 0.0 AS threshold,
  "drop" >= threshold AS kept FROM judged""",
    ),
)
def shallow_rep_filter(spark, sf):
    _, intervals, _ = posture.posture_steps(_frames(spark, sf), PROFILE)
    return intervals.select(
        "set_id", "start_idx", "end_idx", r6(F.col("drop")).alias("rep_drop"), r6(F.col("threshold")).alias("threshold"), "kept"
    )


@query(
    "first_last_reps__G5",
    check(
        REPS,
        """SELECT set_id, rep_count, f.a AS first_start, l.b AS last_end,
  CASE WHEN rep_count < 2 THEN concat('only ', rep_count, ' valid rep(s) detected') END AS skip_reason FROM ends""",
    ),
)
def first_last_reps(spark, sf):
    _, _, ends = posture.posture_steps(_frames(spark, sf), PROFILE)
    return ends.select(
        "set_id",
        "rep_count",
        F.col("first_rep.start_idx").alias("first_start"),
        F.col("last_rep.end_idx").alias("last_end"),
        "skip_reason",
    )


@query(
    "resampled_reps__G6",
    check(REPS, "SELECT set_id, which, k, joint, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny FROM sampled"),
)
def resampled_reps(spark, sf):
    poses, _, ends = posture.posture_steps(_frames(spark, sf), PROFILE)
    points = posture.resample_reps(poses, ends, PROFILE.joints)
    sides = [
        F.struct(F.lit(w).alias("which"), F.arrays_zip(F.col(f"{w}_x").alias("nx"), F.col(f"{w}_y").alias("ny")).alias("p"))
        for w in ("first", "last")
    ]
    long = points.select("set_id", "k", F.explode(F.array(*sides)).alias("s"))
    return long.select("set_id", "k", F.col("s.which").alias("which"), F.posexplode("s.p").alias("j", "n")).select(
        "set_id", "which", "k", (F.col("j") + 10).alias("joint"), r6(F.col("n.nx")).alias("nx"), r6(F.col("n.ny")).alias("ny")
    )


LEVEL = """CASE WHEN d_value < 0.5 THEN 'EXCELLENT - Minimal form breakdown' WHEN d_value < 1.0 THEN 'GOOD - Minor form changes'
  WHEN d_value < 1.5 THEN 'MODERATE - Noticeable form deviation' WHEN d_value IS NOT NULL THEN 'HIGH - Significant form breakdown' END"""


@query(
    "posture_drift__G7",
    check(REPS, "SELECT e.set_id, rep_count, round(d_value, 6) + 0.0 AS d_value FROM ends e LEFT JOIN drift d USING (set_id)"),
)
def posture_drift(spark, sf):
    return posture.posture_summary(_frames(spark, sf), PROFILE).select(
        "set_id", "rep_count", r6(F.col("d_value")).alias("d_value")
    )


DRIFT = "SELECT e.set_id, rep_count, round(d_value, 6) + 0.0 AS d_value FROM ends e LEFT JOIN drift d USING (set_id)"
BENCH_PROFILE, DEADLIFT_PROFILE = posture.BENCH.with_(min_rep_frames=4), posture.DEADLIFT.with_(min_rep_frames=4)


@query("posture_drift_bench__G7", check(reps_sql(BENCH_PROFILE), DRIFT))
def posture_drift_bench(spark, sf):
    return posture.posture_summary(_frames(spark, sf), BENCH_PROFILE).select("set_id", "rep_count", r6(F.col("d_value")).alias("d_value"))


@query("posture_drift_deadlift__G7", check(reps_sql(DEADLIFT_PROFILE), DRIFT))
def posture_drift_deadlift(spark, sf):
    return posture.posture_summary(_frames(spark, sf), DEADLIFT_PROFILE).select("set_id", "rep_count", r6(F.col("d_value")).alias("d_value"))


def by_lift_sql(select: str) -> str:
    """``select`` for each set by the rules of its lift."""
    rules = (PROFILE, BENCH_PROFILE, DEADLIFT_PROFILE)
    return " UNION ALL ".join(f"SELECT * FROM ({check(reps_sql(p), select)}) WHERE set_id % 3 = {i}" for i, p in enumerate(rules))


def summaries_by_lift(spark, sf):
    """Posture summaries; sets are of the three lifts in turn."""
    frames = _frames(spark, sf)
    names = F.array(*[F.lit(name) for name in posture.PROFILES])
    lifts = frames.select("set_id").distinct().withColumn("lift", F.element_at(names, (F.col("set_id") % 3 + 1).cast("int")))
    return posture.posture_by_lift(frames, lifts, {name: p.with_(min_rep_frames=4) for name, p in posture.PROFILES.items()})


@query("posture_by_lift__G7", by_lift_sql(DRIFT))
def posture_by_lift(spark, sf):
    return summaries_by_lift(spark, sf).select("set_id", "rep_count", r6(F.col("d_value")).alias("d_value"))


@query(
    "drift_level__G8",
    cte("posture_full", extra={"d": "SELECT video_name, round(d_value, 9) AS d_value FROM posture_full"})
    + f"SELECT video_name, {LEVEL} AS level FROM d",
)
def drift_level(spark, sf):
    return fx.posture_full(spark, sf).select("video_name", posture.drift_level(F.round("d_value", 9)).alias("level"))


# --- joint motion -----------------------------------------------------------------

JW = "OVER (PARTITION BY set_id, person, joint ORDER BY frame_index)"
MOTION = {
    "moved": f"SELECT *, x - lag(x) {JW} AS vx, y - lag(y) {JW} AS vy FROM pose_joint",
    "accel": f"SELECT *, vx - lag(vx) {JW} AS ax, vy - lag(vy) {JW} AS ay FROM moved",
}


@query(
    "joint_velocity__S15",
    check(
        MOTION,
        """SELECT set_id, person, joint, frame_index, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy,
  round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay FROM accel""",
    ),
)
def joint_velocity(spark, sf):
    out = signals.joint_speed(fx.pose_joint(spark, sf), ["set_id", "person", "joint"], "frame_index")
    return out.select("set_id", "person", "joint", "frame_index", *[r6(F.col(c)).alias(c) for c in ("vx", "vy", "ax", "ay")])


@query(
    "hold_last_pose__S16",
    cte(
        "frame_signal",
        extra={
            "thin": "SELECT set_id, pos, CASE WHEN pos % 20 < 4 THEN y END AS y FROM frame_signal",
            "held": """SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS seen,
  last_value(y IGNORE NULLS) OVER w AS v FROM thin WINDOW w AS (PARTITION BY set_id ORDER BY pos)""",
        },
    )
    + "SELECT set_id, pos, CASE WHEN pos - seen <= 12 THEN v END AS y FROM held",
)
def hold_last_pose(spark, sf):
    thin = fx.frame_signal(spark, sf).select("set_id", "pos", F.when(F.col("pos") % 20 < 4, F.col("y")).alias("y"))
    return signals.hold_last(thin, "y", "y", 12).select("set_id", "pos", "y")


@query(
    "motion_features__S17",
    check(
        {
            "moved": """SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM pose_joint WHERE person = 0
  WINDOW w AS (PARTITION BY set_id, joint ORDER BY frame_index)""",
            "steps": """SELECT set_id, frame_index, CASE WHEN count(vx) = count(*) THEN avg(sqrt(vx * vx + vy * vy)) END AS v
  FROM moved WHERE frame_index > 0 GROUP BY set_id, frame_index""",
            "speeds": "SELECT set_id, avg(v) AS m, max(v) AS x, stddev_pop(v) AS s FROM steps GROUP BY set_id",
            "spans": "SELECT set_id, max(greatest(x, y)) - min(least(x, y)) AS r FROM moved GROUP BY set_id",
        },
        """SELECT set_id, round(m, 6) + 0.0 AS pose_mean_velocity, round(x, 6) + 0.0 AS pose_max_velocity,
  round(r, 6) + 0.0 AS pose_range_of_motion, round(s, 6) + 0.0 AS pose_smoothness FROM speeds JOIN spans USING (set_id)""",
    ),
)
def motion_features(spark, sf):
    out = posture.motion_features(posture.first_person(fx.pose_joint(spark, sf)))
    return out.select("set_id", *[r6(F.col(c)).alias(c) for c in out.columns if c != "set_id"])


@query(
    "time_interpolation__J7",
    check(
        {
            "samples": "SELECT set_id, joint, frame_index, x, y FROM pose_joint WHERE person = 0 AND frame_index % 7 = 0",
            "spine": "SELECT DISTINCT set_id, joint, frame_index AS f FROM pose_joint WHERE person = 0",
            "around": """SELECT s.set_id, s.joint, f, max(p.frame_index) AS a,
  (SELECT min(n.frame_index) FROM samples n WHERE n.set_id = s.set_id AND n.joint = s.joint AND n.frame_index >= f) AS b
  FROM spine s LEFT JOIN samples p ON p.set_id = s.set_id AND p.joint = s.joint AND p.frame_index < f GROUP BY s.set_id, s.joint, f""",
            "ends": """SELECT o.*, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM around o
  LEFT JOIN samples p ON p.set_id = o.set_id AND p.joint = o.joint AND p.frame_index = a
  LEFT JOIN samples q ON q.set_id = o.set_id AND q.joint = o.joint AND q.frame_index = b""",
        },
        """SELECT set_id, joint, f AS frame_index,
  round(CASE WHEN a IS NULL THEN qx WHEN b IS NULL THEN px ELSE px * (1 - (f - a) / CAST(b - a AS DOUBLE)) + qx * ((f - a) / CAST(b - a AS DOUBLE)) END, 6) + 0.0 AS x,
  round(CASE WHEN a IS NULL THEN qy WHEN b IS NULL THEN py ELSE py * (1 - (f - a) / CAST(b - a AS DOUBLE)) + qy * ((f - a) / CAST(b - a AS DOUBLE)) END, 6) + 0.0 AS y
  FROM ends""",
    ),
)
def time_interpolation(spark, sf):
    one = posture.first_person(fx.pose_joint(spark, sf))
    last = one.groupBy("set_id", "joint").agg(F.max("frame_index").alias("last_frame"))
    samples = signals.stride_frames(one, F.lit(21.0), F.lit(3.0)).join(last, ["set_id", "joint"])
    out = signals.interpolate_track(samples, ["x", "y"], ["set_id", "joint"], "last_frame")
    return out.select("set_id", "joint", "frame_index", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(
    "rep_frames__J9",
    check(
        REPS,
        """SELECT i.set_id, start_idx, end_idx, count(*) AS n_frames, round(max(s.z), 6) + 0.0 AS highest
  FROM intervals i JOIN signed s ON s.set_id = i.set_id AND s.pos BETWEEN start_idx AND end_idx GROUP BY i.set_id, start_idx, end_idx""",
    ),
)
def rep_frames(spark, sf):
    poses = posture.placed_poses(_frames(spark, sf), PROFILE)
    from ..session import cut_lineage

    signal = cut_lineage(posture.smoothed_rep_signal(poses, PROFILE), "rep_signal")
    reps = posture.rep_intervals(cut_lineage(posture.rep_bottoms(signal, PROFILE), "bottoms"))
    inside = posture.frames_in_reps(signal, reps.select("set_id", "start_idx", "end_idx"))
    return inside.groupBy("set_id", "start_idx", "end_idx").agg(
        F.count(F.lit(1)).alias("n_frames"), r6(F.max("z")).alias("highest")
    )


# --- person candidates ---------------------------------------------------------------

PIXELS = {
    "pixels": """SELECT set_id, frame_index, person, joint, score, 320 + 400 * x AS x, 240 + 400 * y AS y FROM pose_joint""",
    "masked": """SELECT set_id, frame_index, person, joint, score, CASE WHEN score >= 0.2 THEN x END AS x,
  CASE WHEN score >= 0.2 THEN y END AS y FROM pixels""",
    "torso": """SELECT set_id, frame_index, person,
  count(x) FILTER (WHERE x BETWEEN -32 AND 672 AND y BETWEEN -24 AND 504) / 16.0 AS comp,
  coalesce(sqrt(pow(max(x) FILTER (WHERE joint = 4) - max(x) FILTER (WHERE joint = 5), 2)
    + pow(max(y) FILTER (WHERE joint = 4) - max(y) FILTER (WHERE joint = 5), 2)), 0) AS sw,
  CASE WHEN count(x) FILTER (WHERE joint IN (4, 5, 10, 11)) >= 2 THEN avg(x) FILTER (WHERE joint IN (4, 5, 10, 11)) ELSE avg(x) END AS cx,
  CASE WHEN count(x) FILTER (WHERE joint IN (4, 5, 10, 11)) >= 2 THEN avg(y) FILTER (WHERE joint IN (4, 5, 10, 11)) ELSE avg(y) END AS cy
  FROM masked GROUP BY set_id, frame_index, person""",
    "extent": """SELECT set_id, frame_index, person, count(x) AS n, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2,
  avg(score) AS mean_score, sum(score) FILTER (WHERE joint IN (8, 9)) AS wrists FROM pixels GROUP BY set_id, frame_index, person""",
    "described": """SELECT *, CASE WHEN n >= 4 THEN (x2 - x1) * (y2 - y1) / (640.0 * 480.0) ELSE 0 END AS size,
  comp + 0.25 * least(sw / 60, 2.5) + 0.15 * mean_score AS score FROM torso JOIN extent USING (set_id, frame_index, person)""",
}


def _pixels(spark, sf):
    joints = fx.pose_joint(spark, sf)
    return joints.withColumn("x", 320 + 400 * F.col("x")).withColumn("y", 240 + 400 * F.col("y"))


def _candidates(spark, sf):
    return posture.pose_frames(_pixels(spark, sf), "person")


def _described(spark, sf):
    return cd.describe_candidates(_candidates(spark, sf), WIDTH, HEIGHT)


ID = ["set_id", "frame_index", "person"]


@query(
    "joint_confidence_mask__P21",
    check(PIXELS, "SELECT set_id, frame_index, person, joint, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM masked"),
)
def joint_confidence_mask(spark, sf):
    masked = cd.mask_low_scores(_candidates(spark, sf))
    return masked.select(*ID, F.posexplode(F.arrays_zip("x", "y")).alias("joint", "p")).select(
        *ID, "joint", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y")
    )


@query("completeness__G9", check(PIXELS, "SELECT set_id, frame_index, person, round(comp, 6) + 0.0 AS comp FROM torso"))
def completeness(spark, sf):
    return _described(spark, sf).select(*ID, r6(F.col("comp")).alias("comp"))


@query(
    "torso_geometry__G10",
    check(
        PIXELS,
        """SELECT set_id, frame_index, person, round(sw, 6) + 0.0 AS shoulder_width, round(cx, 6) + 0.0 AS center_x,
  round(cy, 6) + 0.0 AS center_y FROM torso""",
    ),
)
def torso_geometry(spark, sf):
    return _described(spark, sf).select(
        *ID,
        r6(F.col("sw")).alias("shoulder_width"),
        r6(F.col("center.x")).alias("center_x"),
        r6(F.col("center.y")).alias("center_y"),
    )


@query(
    "joint_box__G11",
    check(
        PIXELS
        | {
            "tight": """SELECT set_id, frame_index, person, count(x) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy,
  (max(x) - min(x)) * 1.5 AS hw, (max(y) - min(y)) * 1.5 AS hh FROM masked GROUP BY ALL""",
            "padded": """SELECT *, greatest(0, cx - hw) AS x1, greatest(0, cy - hh) AS y1, least(639, cx + hw) AS x2, least(479, cy + hh) AS y2 FROM tight""",
            "kept": "SELECT *, n >= 4 AND x2 - x1 >= 5 AND y2 - y1 >= 5 AS ok FROM padded",
        },
        """SELECT set_id, frame_index, person, CASE WHEN ok THEN round(x1, 6) + 0.0 END AS x1, CASE WHEN ok THEN round(y1, 6) + 0.0 END AS y1,
  CASE WHEN ok THEN round(x2, 6) + 0.0 END AS x2, CASE WHEN ok THEN round(y2, 6) + 0.0 END AS y2 FROM kept""",
    ),
)
def joint_box(spark, sf):
    masked = cd.mask_low_scores(_candidates(spark, sf)).withColumn("b", cd.joint_box(WIDTH, HEIGHT))
    return masked.select(*ID, *[r6(F.col(f"b.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("person_size__G12", check(PIXELS, "SELECT set_id, frame_index, person, round(size, 6) + 0.0 AS size FROM described"))
def person_size(spark, sf):
    return _described(spark, sf).select(*ID, r6(F.col("size")).alias("size"))


@query(
    "candidate_score__G13",
    check(
        PIXELS,
        """SELECT set_id, frame_index, person, round(score, 6) + 0.0 AS score, round(score + 0.3 * size, 6) + 0.0 AS score_sized FROM described""",
    ),
)
def candidate_score(spark, sf):
    return _described(spark, sf).select(
        *ID, r6(F.col("cand_score")).alias("score"), r6(F.col("cand_score_sized")).alias("score_sized")
    )


def _person_boxes(spark, sf):
    raw = _candidates(spark, sf)
    lo, hi = F.array_min, F.array_max
    wrists = F.col("score")[8] + F.col("score")[9]
    return raw.select(*ID, wrists.alias("wrists"), bx.box(lo("x"), lo("y"), hi("x"), hi("y")).alias("bbox"))


@query(
    "lifter_score__G14",
    check(
        PIXELS,
        """SELECT set_id, frame_index, person, round(greatest(1.0, (x2 - x1) * (y2 - y1)) * (1.5 + wrists)
  / (1 + 2 * (pow(((x1 + x2) / 2 - 320) / 320, 2) + pow(((y1 + y2) / 2 - 240) / 240, 2))), 4) + 0.0 AS score FROM extent""",
    ),
)
def lifter_score(spark, sf):
    people = _person_boxes(spark, sf)
    return people.select(*ID, r6(cd.lifter_score(F.col("bbox"), F.col("wrists"), WIDTH, HEIGHT), 4).alias("score"))


@query(
    "nearest_candidate__G15",
    check(
        PIXELS
        | {
            "ranked": """SELECT *, row_number() OVER (PARTITION BY set_id, frame_index
  ORDER BY pow(cx - 320, 2) + pow(cy - 240, 2), score DESC, person) AS rn FROM described"""
        },
        "SELECT set_id, frame_index, person, round(score, 6) + 0.0 AS score FROM ranked WHERE rn = 1",
    ),
)
def nearest_candidate(spark, sf):
    best = cd.pick_best(_described(spark, sf), F.lit(320.0), F.lit(240.0))
    return best.select(*ID, r6(F.col("score")).alias("score"))


@query(
    "best_large_candidate__G15",
    check(
        PIXELS
        | {
            "ranked": """SELECT *, row_number() OVER (PARTITION BY set_id, frame_index ORDER BY score + 0.3 * size DESC, person) AS rn
  FROM described WHERE size >= 0.1"""
        },
        "SELECT set_id, frame_index, person, round(score + 0.3 * size, 6) + 0.0 AS score FROM ranked WHERE rn = 1",
    ),
)
def best_large_candidate(spark, sf):
    best = cd.pick_best(_described(spark, sf), score="cand_score_sized", min_size=0.1)
    return best.select(*ID, r6(F.col("score")).alias("score"))


@query(
    "bootstrap_pick__G16",
    check(
        PIXELS
        | {
            "sizes": "SELECT set_id, (max(frame_index) + 1) // 2 AS mid FROM pose_joint GROUP BY set_id",
            "ranked": """SELECT d.*, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, frame_index, person) AS rn
  FROM described d JOIN sizes USING (set_id)
  WHERE comp >= 0.5 AND frame_index BETWEEN greatest(0, mid - 20) AND greatest(0, mid - 20) + 40""",
        },
        "SELECT set_id, frame_index, person, round(score, 6) + 0.0 AS score FROM ranked WHERE rn = 1",
    ),
)
def bootstrap_pick(spark, sf):
    return cd.bootstrap_pick(_described(spark, sf)).select(*ID, r6(F.col("score")).alias("score"))


@query(
    "wrist_side__G17",
    check(
        PIXELS
        | {
            "sides": """SELECT set_id, coalesce(sum(score) FILTER (WHERE joint = 8), 0) AS lq, coalesce(sum(score) FILTER (WHERE joint = 9), 0) AS rq,
  avg(x) FILTER (WHERE joint = 8) AS lx, avg(y) FILTER (WHERE joint = 8) AS ly, avg(x) FILTER (WHERE joint = 9) AS rx,
  avg(y) FILTER (WHERE joint = 9) AS ry FROM pixels WHERE person = 0 AND score >= 0.35 GROUP BY set_id"""
        },
        """SELECT set_id, CASE WHEN rq > lq THEN 'right' ELSE 'left' END AS side,
  round(CASE WHEN rq > lq THEN rx ELSE lx END, 6) + 0.0 AS center_x, round(CASE WHEN rq > lq THEN ry ELSE ly END, 6) + 0.0 AS center_y
  FROM sides WHERE lq > 0 OR rq > 0""",
    ),
)
def wrist_side(spark, sf):
    out = cd.wrist_side(posture.first_person(_pixels(spark, sf)), 8, 9)
    return out.select("set_id", "side", r6(F.col("center_x")).alias("center_x"), r6(F.col("center_y")).alias("center_y"))


@query(
    "pose_wrist__G18",
    check(
        PIXELS
        | {
            "w": """SELECT set_id, frame_index, person,
  coalesce(max({'x': x, 'y': y, 's': score}) FILTER (WHERE joint = 9 AND score >= 0.35),
           max({'x': x, 'y': y, 's': score}) FILTER (WHERE joint = 8 AND score >= 0.35)) AS w FROM pixels GROUP BY ALL"""
        },
        """SELECT set_id, frame_index, person, round(w.x, 6) + 0.0 AS x, round(w.y, 6) + 0.0 AS y, round(w.s, 6) + 0.0 AS score FROM w""",
    ),
)
def pose_wrist(spark, sf):
    out = _candidates(spark, sf).withColumn("w", cd.pose_wrist("right", 8, 9))
    return out.select(*ID, *[r6(F.col(f"w.{c}")).alias(c) for c in ("x", "y", "score")])


@query(
    "side_view__G19",
    check(
        PIXELS
        | {
            "e": """SELECT set_id, frame_index, person, sqrt(pow(max(x) FILTER (WHERE joint = 6) - max(x) FILTER (WHERE joint = 7), 2)
    + pow(max(y) FILTER (WHERE joint = 6) - max(y) FILTER (WHERE joint = 7), 2)) AS sep FROM masked GROUP BY ALL"""
        },
        """SELECT set_id, frame_index, person, CASE WHEN sw < 20 THEN true ELSE coalesce(sep / sw < 0.45, false) END AS side_view
  FROM e JOIN torso USING (set_id, frame_index, person)""",
    ),
)
def side_view(spark, sf):
    return cd.mask_low_scores(_candidates(spark, sf)).select(*ID, cd.likely_side_view().alias("side_view"))


HEADS = PIXELS | {
    "heads": """SELECT set_id, frame_index, count(x) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM pixels
  WHERE person = 0 AND joint <= 5 AND score > 0.2 GROUP BY set_id, frame_index""",
    "every": "SELECT DISTINCT set_id, frame_index FROM pixels WHERE person = 0",
    "head_box": """SELECT set_id, frame_index, CASE WHEN n >= 3 THEN CAST(trunc(greatest(0, x1 - (x2 - x1))) AS INT) END AS x1,
  CASE WHEN n >= 3 THEN CAST(trunc(greatest(0, y1 - 1.5 * (y2 - y1))) AS INT) END AS y1,
  CASE WHEN n >= 3 THEN CAST(trunc(least(640, x2 + (x2 - x1))) AS INT) END AS x2,
  CASE WHEN n >= 3 THEN CAST(trunc(least(480, y2 + 2 * (y2 - y1))) AS INT) END AS y2
  FROM every LEFT JOIN heads USING (set_id, frame_index)""",
}


def _head_boxes(spark, sf):
    return cd.head_box(posture.first_person(_pixels(spark, sf)), range(6), WIDTH, HEIGHT)


@query("head_box__G20", check(HEADS, "SELECT set_id, frame_index, x1, y1, x2, y2 FROM head_box"))
def head_box(spark, sf):
    return _head_boxes(spark, sf)


@query(
    "fixed_crop__G21",
    check(
        HEADS
        | {
            "m": """SELECT set_id, CAST(trunc(median(x1)) AS INT) AS x1, CAST(trunc(median(y1)) AS INT) AS y1, CAST(trunc(median(x2)) AS INT) AS x2,
  CAST(trunc(median(y2)) AS INT) AS y2, CAST(trunc(max(x2 - x1) * CAST(1.2 AS DOUBLE)) AS INT) AS w, CAST(trunc(max(y2 - y1) * CAST(1.2 AS DOUBLE)) AS INT) AS h
  FROM head_box WHERE x1 IS NOT NULL GROUP BY set_id""",
            "c": "SELECT *, greatest(0, (x1 + x2) // 2 - w // 2) AS a, greatest(0, (y1 + y2) // 2 - h // 2) AS b FROM m",
            "e": "SELECT *, least(640, a + w) AS a2, least(480, b + h) AS b2 FROM c",
        },
        """SELECT set_id, CASE WHEN a2 - a < w THEN greatest(0, a2 - w) ELSE a END AS crop_x1,
  CASE WHEN b2 - b < h THEN greatest(0, b2 - h) ELSE b END AS crop_y1, a2 AS crop_x2, b2 AS crop_y2 FROM e""",
    ),
)
def fixed_crop(spark, sf):
    return cd.fixed_crop(_head_boxes(spark, sf), int(WIDTH), int(HEIGHT))


@query(
    "box_smoothing__S18",
    check(
        HEADS
        | {
            "tap": """SELECT b.set_id, b.frame_index, b.x1, b.y2, avg(coalesce(o.x1, 0)) AS sx1, avg(coalesce(o.y2, 0)) AS sy2
  FROM head_box b, range(-7, 8) t(d), head_box o
  WHERE o.set_id = b.set_id AND o.frame_index = greatest(0, least(49, b.frame_index + d)) GROUP BY ALL"""
        },
        """SELECT set_id, frame_index, CASE WHEN x1 IS NOT NULL THEN CAST(trunc(sx1) AS INT) END AS x1_smooth,
  CASE WHEN y2 IS NOT NULL THEN CAST(trunc(sy2) AS INT) END AS y2_smooth FROM tap""",
    ),
)
def box_smoothing(spark, sf):
    placed = _head_boxes(spark, sf).withColumn("pos", F.col("frame_index").cast("long"))
    return signals.smooth_boxes(placed, ["x1", "y1", "x2", "y2"]).select("set_id", "frame_index", "x1_smooth", "y2_smooth")


@query(
    "box_fill__S19",
    check(
        HEADS
        | {
            "f": """SELECT set_id, frame_index, coalesce(last_value(x1 IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY frame_index),
  first_value(x1 IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x1,
  coalesce(last_value(y2 IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY frame_index),
  first_value(y2 IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y2 FROM head_box"""
        },
        "SELECT set_id, frame_index, x1, y2 FROM f",
    ),
)
def box_fill(spark, sf):
    placed = _head_boxes(spark, sf).withColumn("pos", F.col("frame_index").cast("long"))
    return signals.fill_boxes(placed, ["x1", "y1", "x2", "y2"]).select("set_id", "frame_index", "x1", "y2")


@query(
    "small_person_filter__S20",
    check(
        HEADS
        | {
            "tall": "SELECT set_id, frame_index, coalesce(max(y) - min(y), 0) AS size FROM pixels WHERE person = 0 AND score > 0.3 GROUP BY ALL",
            "mid": "SELECT set_id, median(size) AS m FROM tall WHERE size > 0 GROUP BY set_id",
        },
        """SELECT set_id, frame_index, CASE WHEN size > 0 AND size < CAST(0.6 AS DOUBLE) * m THEN NULL ELSE x1 END AS x1
  FROM head_box LEFT JOIN tall USING (set_id, frame_index) LEFT JOIN mid USING (set_id)""",
    ),
)
def small_person_filter(spark, sf):
    one = posture.first_person(_pixels(spark, sf))
    tall = one.filter("score > 0.3").groupBy("set_id", "frame_index").agg(
        F.coalesce(F.max("y") - F.min("y"), F.lit(0.0)).alias("size")
    )
    boxes = _head_boxes(spark, sf).join(tall, ["set_id", "frame_index"], "left")
    return cd.drop_small_persons(boxes).select("set_id", "frame_index", "x1")


@query(
    "previous_box_match__J6",
    check(
        PIXELS
        | {
            "largest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id, frame_index
  ORDER BY greatest(1.0, (x2 - x1) * (y2 - y1)) DESC, person) AS rn FROM extent) t WHERE rn = 1""",
            "paired": """SELECT e.*, p.x1 AS a1, p.y1 AS b1, p.x2 AS a2, p.y2 AS b2, p.set_id IS NOT NULL AS matched,
  greatest(0, least(e.x2, p.x2) - greatest(e.x1, p.x1)) * greatest(0, least(e.y2, p.y2) - greatest(e.y1, p.y1)) AS inter
  FROM extent e LEFT JOIN largest p ON p.set_id = e.set_id AND p.frame_index + 1 = e.frame_index""",
            "valued": """SELECT *, CASE WHEN NOT matched THEN greatest(1.0, (x2 - x1) * (y2 - y1))
  ELSE inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter) END AS v FROM paired""",
            "best": "SELECT *, row_number() OVER (PARTITION BY set_id, frame_index ORDER BY v DESC, person) AS rn FROM valued",
        },
        "SELECT set_id, frame_index, person, round(v, 4) + 0.0 AS rank_value, matched FROM best WHERE rn = 1",
    ),
)
def previous_box_match(spark, sf):
    out = cd.match_previous_box(_person_boxes(spark, sf))
    return out.select("set_id", "frame_index", "person", r6(F.col("rank_value"), 4).alias("rank_value"), "matched")


# --- boxes -----------------------------------------------------------------------

BOXES = {
    "vecs": """SELECT vec_id, list_transform(embedding[1:3 + label % 2], lambda v: CAST(v AS DOUBLE)) AS b,
  list_transform(embedding[5:8], lambda v: CAST(v AS DOUBLE)) AS c FROM embeddings""",
    "cornered": """SELECT vec_id, b[1] AS x1, b[2] AS y1, CASE WHEN b[3] > b[1] AND b[4] > b[2] THEN b[3] ELSE b[1] + b[3] END AS x2,
  CASE WHEN b[3] > b[1] AND b[4] > b[2] THEN b[4] ELSE b[2] + b[4] END AS y2,
  c[1] AS p1, c[2] AS q1, CASE WHEN c[3] > c[1] AND c[4] > c[2] THEN c[3] ELSE c[1] + c[3] END AS p2,
  CASE WHEN c[3] > c[1] AND c[4] > c[2] THEN c[4] ELSE c[2] + c[4] END AS q2, len(b) >= 4 AS ok FROM vecs""",
    "inter": """SELECT *, greatest(0, least(x2, p2) - greatest(x1, p1)) * greatest(0, least(y2, q2) - greatest(y1, q1)) AS i,
  greatest(0, x2 - x1) * greatest(0, y2 - y1) + greatest(0, p2 - p1) * greatest(0, q2 - q1) AS areas,
  (x2 - x1) * (y2 - y1) + (p2 - p1) * (q2 - q1) AS signed FROM cornered""",
}


def _box_pairs(spark, sf):
    vecs = fx.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    as_double = "array<double>"
    return vecs.select(
        "vec_id",
        bx.corners(F.slice("embedding", F.lit(1), F.lit(3) + F.col("label") % 2).cast(as_double)).alias("b"),
        bx.corners(F.slice("embedding", 5, 4).cast(as_double)).alias("c"),
    )


@query(
    "box_normalize__P17",
    "WITH " + ", ".join(f"{n} AS ({q})" for n, q in BOXES.items())
    + """ SELECT vec_id, CASE WHEN ok THEN round(x1, 6) + 0.0 END AS x1, CASE WHEN ok THEN round(y1, 6) + 0.0 END AS y1,
  CASE WHEN ok THEN round(x2, 6) + 0.0 END AS x2, CASE WHEN ok THEN round(y2, 6) + 0.0 END AS y2 FROM cornered""",
)
def box_normalize(spark, sf):
    return _box_pairs(spark, sf).select("vec_id", *[r6(F.col(f"b.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "box_iou__P18",
    "WITH " + ", ".join(f"{n} AS ({q})" for n, q in BOXES.items())
    + """ SELECT vec_id, CASE WHEN ok AND areas - i > 0 THEN round(i / (areas - i), 6) + 0.0 ELSE 0 END AS iou,
  CASE WHEN ok THEN round(i / greatest(signed - i, 0.000001), 4) + 0.0 END AS iou_floored FROM inter""",
)
def box_iou(spark, sf):
    pairs = _box_pairs(spark, sf)
    return pairs.select(
        "vec_id",
        r6(bx.iou(F.col("b"), F.col("c"))).alias("iou"),
        F.when(F.col("b").isNotNull(), r6(bx.iou_floored(F.col("b"), F.col("c")), 4)).alias("iou_floored"),
    )
