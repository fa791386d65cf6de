"""Posture drift: distance between the first and the last repetition's poses.

Pose frames carry ``x`` and ``y`` as arrays of 16 joints (null = missing).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import concurrently, cut_lineage
from . import tracks
from .peaks import thin_by_distance
from .signals import local_tops, smooth_signal
from .tracks import block_of, bracket, neighbours

# Joint numbers of the 16-joint layout.
JOINTS = 16
L_SHOULDER, R_SHOULDER = 4, 5
L_ELBOW, R_ELBOW = 6, 7
L_WRIST, R_WRIST = 8, 9
L_HIP, R_HIP = 10, 11
SAMPLES = 100


@dataclass(frozen=True)
class LiftProfile:
    """How one lift is read: joints, direction, thresholds.

    ``sign`` +1 takes local maxima of the signal as bottoms, -1 minima.
    ``signal_frame`` "normalized" reads the signal after re-centring;
    "raw_scaled" only divides by body scale (a signal taken from the joints
    that define the origin is always 0 after re-centring).
    """

    lift: str
    origin: tuple[int, int]
    signal: tuple[int, int]
    sign: int
    min_rep_frames: int
    prominence_share: float
    min_drop: float
    joints: tuple[int, ...]
    signal_frame: str = "normalized"
    median_taps: int = 5
    ema_alpha: float = 0.35
    drop_share: float = 0.5

    def with_(self, **changes) -> "LiftProfile":
        return replace(self, **changes)


# Fixed values of the three lifts.
SQUAT = LiftProfile("Squat", (L_HIP, R_HIP), (L_SHOULDER, R_SHOULDER), 1, 35, 0.20, 0.25, tuple(range(10, 16)))
BENCH = LiftProfile("Bench Press", (L_SHOULDER, R_SHOULDER), (L_WRIST, R_WRIST), -1, 25, 0.15, 0.20, tuple(range(4, 10)))
DEADLIFT = LiftProfile(
    "Deadlift", (L_HIP, R_HIP), (L_HIP, R_HIP), -1, 30, 0.18, 0.25, tuple(range(4, 16)), signal_frame="raw_scaled"
)
PROFILES = {p.lift: p for p in (SQUAT, BENCH, DEADLIFT)}


def pose_frames(joints: DataFrame, *extra: str) -> DataFrame:
    """Joint rows to one row per frame (and per ``extra`` key) with arrays."""

    def packed(name: str) -> Column:
        return F.array(*[F.max(F.when(F.col("joint") == j, F.col(name))) for j in range(JOINTS)])

    names = ["x", "y"] + (["score"] if "score" in joints.columns else [])
    return joints.groupBy("set_id", "frame_index", *extra).agg(*[packed(n).alias(n) for n in names])


def first_person(joints: DataFrame) -> DataFrame:
    return joints.filter("person = 0").drop("person")


def _mid(name: str, pair: tuple[int, int]) -> Column:
    return (F.col(name)[pair[0]] + F.col(name)[pair[1]]) * 0.5


def pair_distance(a: int, b: int) -> Column:
    return F.sqrt(F.pow(F.col("x")[a] - F.col("x")[b], 2) + F.pow(F.col("y")[a] - F.col("y")[b], 2))


def body_scale() -> Column:
    """Shoulder width, hip width where that is missing or tiny, at least 1e-3."""
    shoulders, hips = pair_distance(L_SHOULDER, R_SHOULDER), pair_distance(L_HIP, R_HIP)
    chosen = F.when(shoulders >= 1e-3, shoulders).otherwise(hips)
    return F.when(chosen.isNotNull(), F.greatest(chosen, F.lit(1e-3)))


def normalize_pose(frames: DataFrame, origin: tuple[int, int] = (L_HIP, R_HIP)) -> DataFrame:
    """Adds ``nx``, ``ny`` (centred on ``origin``, divided by scale) and ``scale``."""
    scaled = frames.withColumn("scale", body_scale()).withColumn("_ox", _mid("x", origin)).withColumn("_oy", _mid("y", origin))
    return (
        scaled.withColumn("nx", F.transform("x", lambda v: (v - F.col("_ox")) / F.col("scale")))
        .withColumn("ny", F.transform("y", lambda v: (v - F.col("_oy")) / F.col("scale")))
        .drop("_ox", "_oy")
    )


def rep_signal(profile: LiftProfile) -> Column:
    if profile.signal_frame == "raw_scaled":
        return _mid("y", profile.signal) / F.col("scale")
    return _mid("ny", profile.signal)


def placed_poses(frames: DataFrame, profile: LiftProfile) -> DataFrame:
    """Normalised poses with their position in the sampled track."""
    return tracks.frame_positions(normalize_pose(frames, profile.origin))


def smoothed_rep_signal(poses: DataFrame, profile: LiftProfile) -> DataFrame:
    raw = poses.select("set_id", "pos", rep_signal(profile).alias("signal"))
    return smooth_signal(raw, "signal", "signal", profile.ema_alpha, profile.median_taps).withColumn(
        "z", F.col("signal") * profile.sign
    )


def rep_bottoms(signal: DataFrame, profile: LiftProfile) -> DataFrame:
    tops = local_tops(signal, "signal", profile.min_rep_frames, profile.prominence_share, sign=profile.sign)
    return thin_by_distance(tops, profile.min_rep_frames).select("set_id", "pos", "height")


def rep_intervals(bottoms: DataFrame) -> DataFrame:
    """Consecutive bottoms: start, end, heights at both."""
    return (
        neighbours(bottoms, ["height"])
        .filter(F.col("next").isNotNull())
        .select(
            "set_id",
            "pos",
            F.col("pos").alias("start_idx"),
            F.col("next.pos").alias("end_idx"),
            F.col("height").alias("bottom_z"),
            F.col("next.height").alias("_end_z"),
        )
    )


def rep_drops(signal: DataFrame, bottoms: DataFrame) -> DataFrame:
    """Drop of each interval: bottom height minus the lowest sample inside."""
    marks = bottoms.select("set_id", "pos", block_of("pos").alias("block"), F.lit(True).alias("_bottom"))
    flagged = signal.withColumn("block", block_of("pos")).join(marks, ["set_id", "block", "pos"], "left").drop("block")
    inside = bracket(flagged, [], F.col("_bottom")).filter(F.col("prev").isNotNull())
    lows = inside.groupBy("set_id", F.col("prev.pos").alias("pos")).agg(F.min("z").alias("_low"))
    return (
        rep_intervals(bottoms)
        .join(lows, ["set_id", "pos"])
        .withColumn("top_z", F.least("_low", "_end_z"))
        .withColumn("drop", F.col("bottom_z") - F.col("top_z"))
        .drop("_low", "_end_z")
    )


def keep_deep_reps(intervals: DataFrame, profile: LiftProfile) -> DataFrame:
    """Adds ``threshold`` and ``kept``: drop at least the larger of ``min_drop``
    and half the set's deepest drop."""
    deepest = intervals.groupBy("set_id").agg(F.max("drop").alias("_max"), tracks.last_block())
    return (
        tracks.with_set_stats(intervals, deepest)
        .withColumn("threshold", F.greatest(F.lit(profile.min_drop), F.col("_max") * profile.drop_share))
        .withColumn("kept", F.col("drop") >= F.col("threshold"))
        .drop("_max")
    )


def first_last_reps(intervals: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set: kept repetitions, first and last one, skip reason (null if two or more)."""
    kept = intervals.filter("kept").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("rep_count"),
        F.min(F.struct("start_idx", "end_idx")).alias("first_rep"),
        F.max(F.struct("start_idx", "end_idx")).alias("last_rep"),
    )
    n = F.coalesce(F.col("rep_count"), F.lit(0))
    return (
        sets.select("set_id")
        .distinct()
        .join(kept, "set_id", "left")
        .withColumn("rep_count", n)
        .withColumn(
            "skip_reason",
            F.when(F.col("rep_count") < 2, F.format_string("only %d valid rep(s) detected", "rep_count")),
        )
    )


def frames_in_reps(frames: DataFrame, reps: DataFrame) -> DataFrame:
    """Every frame inside [start_idx, end_idx] of each repetition.

    Repetitions are copied to the blocks they touch, so the range condition
    is the residue of an equi join on (set, block).
    """
    spans = reps.withColumn("block", F.explode(F.sequence(block_of("start_idx"), block_of("end_idx"))))
    return (
        frames.withColumn("block", block_of("pos"))
        .join(spans, ["set_id", "block"])
        .filter("pos BETWEEN start_idx AND end_idx")
        .drop("block")
    )


def resample_plan(reps: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For each end repetition, the frames and weights of its ``samples`` points.

    ``reps`` has ``first_rep`` and ``last_rep``; one row per set, rep and point.
    """
    ends = reps.filter(F.col("skip_reason").isNull()).select(
        "set_id",
        F.explode(
            F.array(
                F.struct(F.lit("first").alias("which"), F.col("first_rep.start_idx").alias("a"), F.col("first_rep.end_idx").alias("b")),
                F.struct(F.lit("last").alias("which"), F.col("last_rep.start_idx").alias("a"), F.col("last_rep.end_idx").alias("b")),
            )
        ).alias("r"),
    )
    at = F.col("k") * (F.col("r.b") - F.col("r.a")) / F.lit(float(samples - 1))
    return (
        ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_at", at)
        .select(
            "set_id",
            F.col("r.which").alias("which"),
            "k",
            (F.col("r.a") + F.floor("_at")).alias("low"),
            (F.col("_at") - F.floor("_at")).alias("share"),
        )
    )


def resample_reps(poses: DataFrame, reps: DataFrame, joints: tuple[int, ...], samples: int = SAMPLES) -> DataFrame:
    """First and last repetition at ``samples`` even points: arrays over ``joints``.

    Columns ``first_x`` ... ``last_y``; a missing joint at a needed frame stays missing.
    """
    ends = F.when(F.col("share") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    needed = resample_plan(reps, samples).withColumn("side", F.explode(ends)).withColumn("pos", F.col("low") + F.col("side"))
    kept = [F.array(*[F.col(n)[j] for j in joints]).alias(n) for n in ("nx", "ny")]
    found = needed.join(poses.select("set_id", "pos", *kept), ["set_id", "pos"])

    def pick(which: str, side: int, name: str) -> Column:
        hit = (F.col("which") == which) & (F.col("side") == side)
        return F.any_value(F.when(hit, F.col(name)), F.lit(True))

    aggs = [F.max(F.when(F.col("which") == w, F.col("share"))).alias(f"{w}_share") for w in ("first", "last")]
    aggs += [pick(w, s, n).alias(f"{w}_{s}_{n}") for w in ("first", "last") for s in (0, 1) for n in ("nx", "ny")]
    points = found.groupBy("set_id", "k").agg(*aggs)

    def blend(which: str, name: str) -> Column:
        low, high, share = F.col(f"{which}_0_{name}"), F.col(f"{which}_1_{name}"), F.col(f"{which}_share")
        return F.when(high.isNull(), low).otherwise(F.zip_with(low, high, lambda p, q: p + (q - p) * share))

    return points.select(
        "set_id", "k", *[blend(w, f"n{c}").alias(f"{w}_{c}") for w in ("first", "last") for c in ("x", "y")]
    )


def drift(resampled: DataFrame) -> DataFrame:
    """Root mean square distance of the two repetitions; null if any joint is missing."""

    def squares(c: str) -> Column:
        return F.zip_with(f"first_{c}", f"last_{c}", lambda p, q: F.pow(p - q, 2))

    both = F.zip_with(squares("x"), squares("y"), lambda p, q: p + q)
    total = F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v)
    per_point = resampled.select("set_id", total.alias("_d"), F.size("first_x").alias("_n"))
    return per_point.groupBy("set_id").agg(
        F.when(F.count("_d") == F.count(F.lit(1)), F.sqrt(F.sum("_d") / F.sum("_n"))).alias("d_value")
    )


def drift_level(d: Column) -> Column:
    return (
        F.when(d < 0.5, "EXCELLENT - Minimal form breakdown")
        .when(d < 1.0, "GOOD - Minor form changes")
        .when(d < 1.5, "MODERATE - Noticeable form deviation")
        .when(d.isNotNull(), "HIGH - Significant form breakdown")
    )


def posture_steps(frames: DataFrame, profile: LiftProfile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed poses, judged intervals and first/last repetition of every set."""
    poses = cut_lineage(placed_poses(frames, profile), "poses")
    signal = cut_lineage(smoothed_rep_signal(poses, profile), "rep_signal")
    bottoms = cut_lineage(rep_bottoms(signal, profile), "bottoms")
    drops = cut_lineage(rep_drops(signal, bottoms), "drops")
    intervals = keep_deep_reps(drops, profile)
    sets = poses.select("set_id")
    return poses, intervals, first_last_reps(intervals, sets)


def posture_summary(frames: DataFrame, profile: LiftProfile) -> DataFrame:
    """Per set: kept repetitions, first and last one, drift, skip reason."""
    poses, _, ends = posture_steps(frames, profile)
    ends = cut_lineage(ends, "end_reps")
    distance = drift(resample_reps(poses, ends, profile.joints))
    return ends.join(distance, "set_id", "left").select(
        "set_id",
        "rep_count",
        F.col("first_rep.start_idx").alias("first_rep_start"),
        F.col("first_rep.end_idx").alias("first_rep_end"),
        F.col("last_rep.start_idx").alias("last_rep_start"),
        F.col("last_rep.end_idx").alias("last_rep_end"),
        "d_value",
        "skip_reason",
    )


def posture_by_lift(frames: DataFrame, lifts: DataFrame, profiles: dict[str, LiftProfile] = PROFILES) -> DataFrame:
    """The summary of every set by the rules of its own lift; ``lifts`` has one (set_id, lift) per set.

    There are as many passes as lifts, each over the sets of its lift, at the same time. Sets whose lift has no profile give no row.
    """
    tagged = frames.join(lifts.select("set_id", "lift"), "set_id")
    passes = [lambda name=name, p=p: posture_summary(tagged.filter(F.col("lift") == name).drop("lift"), p) for name, p in profiles.items()]
    parts = concurrently(frames.sparkSession, passes)
    return reduce(DataFrame.unionByName, parts)


def motion_features(joints: DataFrame) -> DataFrame:
    """Mean, largest and spread of joint speed and the range of coordinates.

    Speed is averaged over joints per frame step; a missing joint makes its
    step missing. Sets with fewer than two frames get zeros.
    """
    from .signals import joint_speed

    frames = joints.select("set_id", "frame_index").distinct()
    placed = tracks.frame_positions(frames)
    at = joints.join(placed, ["set_id", "frame_index"])
    moved = joint_speed(at, ["set_id", "joint"])
    speed = F.sqrt(F.pow("vx", 2) + F.pow("vy", 2))
    steps = moved.filter("pos > 0").groupBy("set_id", "pos").agg(
        F.when(F.count(speed) == F.count(F.lit(1)), F.avg(speed)).alias("_v")
    )
    speeds = steps.groupBy("set_id").agg(
        F.avg("_v").alias("_mean"), F.max("_v").alias("_max"), F.stddev_pop("_v").alias("_std")
    )
    spans = joints.groupBy("set_id").agg(
        (F.max(F.greatest("x", "y")) - F.min(F.least("x", "y"))).alias("_range"),
        F.countDistinct("frame_index").alias("_frames"),
    )
    few = F.col("_frames") < 2
    zero = F.lit(0.0)
    return spans.join(speeds, "set_id", "left").select(
        "set_id",
        F.when(few, zero).otherwise(F.col("_mean")).alias("pose_mean_velocity"),
        F.when(few, zero).otherwise(F.col("_max")).alias("pose_max_velocity"),
        F.when(few, zero).otherwise(F.col("_range")).alias("pose_range_of_motion"),
        F.when(few, zero).otherwise(F.col("_std")).alias("pose_smoothness"),
    )
