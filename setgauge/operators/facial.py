"""Facial action-unit summaries per set and face-strain geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import wide_percentiles
from .tracks import block_of

# The exertion action units and their frame columns.
EXERTION_AUS = ["AU04", "AU06", "AU07", "AU09", "AU10", "AU12", "AU17", "AU20", "AU25", "AU26"]
INTENSITY = [f"{au}_r" for au in EXERTION_AUS]
MINIMAL_COLUMNS = ["frame", "timestamp", "success", "confidence", *INTENSITY]
MIN_VALID_FRAMES = 10
MEAN_ACTIVE, MAX_ACTIVE = 1.0, 2.0


def _ok() -> Column:
    return F.col("success") == 1


def detected_frames(frames: DataFrame) -> DataFrame:
    return frames.filter("success = 1")


def detection_columns() -> list[Column]:
    ok = _ok()
    n_ok = F.count(F.when(ok, F.lit(1)))
    conf = F.when(ok, F.col("confidence"))

    def or_zero(value: Column) -> Column:
        return F.when(n_ok > 0, value).otherwise(F.lit(0.0))

    return [
        (n_ok / F.count(F.lit(1))).alias("detection_rate"),
        n_ok.alias("detection_count"),
        F.count(F.lit(1)).alias("total_frames"),
        or_zero(F.avg(conf)).alias("confidence_mean"),
        or_zero(F.stddev_samp(conf)).alias("confidence_std"),
        or_zero(F.min(conf)).alias("confidence_min"),
    ]


def au_max_columns(aus: Sequence[str] = EXERTION_AUS) -> list[Column]:
    return [F.max(F.when(_ok(), F.col(f"{au}_r"))).alias(f"{au}_max") for au in aus]


def active_mean_count(aus: Sequence[str] = EXERTION_AUS, threshold: float = MEAN_ACTIVE) -> Column:
    """How many units have a frame mean above ``threshold``."""
    hits = [F.coalesce((F.avg(F.when(_ok(), F.col(f"{au}_r"))) > threshold).cast("int"), F.lit(0)) for au in aus]
    return sum(hits[1:], hits[0]).alias("au_highly_active_count")


def facial_summary(frames: DataFrame, min_valid: int = MIN_VALID_FRAMES, with_error: bool = True) -> DataFrame:
    """Detection, AU maxima and active count per set from one scan.

    Success is a condition inside the aggregates, so detected and undetected
    frames are read together. Sets with too few valid frames keep only an error.
    """
    aus = [au for au in EXERTION_AUS if f"{au}_r" in frames.columns]
    stats = [*detection_columns(), *au_max_columns(aus), active_mean_count(aus)]
    out = frames.groupBy("set_id").agg(*stats)
    if not with_error:
        return out
    few = F.col("detection_count") < min_valid
    text = F.concat(
        F.lit("Insufficient valid frames ("), F.col("detection_count").cast("string"), F.lit(" detected).")
    )
    names = [c for c in out.columns if c != "set_id"]
    return out.select("set_id", *[F.when(~few, F.col(c)).alias(c) for c in names], F.when(few, text).alias("error"))


# --- mergeable states -----------------------------------------------------------------


def facial_states(frames: DataFrame) -> DataFrame:
    """One row per set from which :func:`facial_summary` follows; rows of one set from different frames can be merged.

    Holds counts, the mean and the sum of squared distances from it, least and largest values, and per action unit the
    sum, number and maximum, so a state is as small for a set of a million frames as for one of ten.
    """
    ok, conf = _ok(), F.when(_ok(), F.col("confidence"))
    known = F.count(conf)
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(ok, F.lit(1))).alias("detected"),
        known.alias("confident"),
        F.avg(conf).alias("conf_mean"),
        (F.var_pop(conf) * known).alias("conf_spread"),
        F.min(conf).alias("conf_min"),
    ]
    for au in (au for au in EXERTION_AUS if f"{au}_r" in frames.columns):
        value = F.when(ok, F.col(f"{au}_r"))
        aggregates += [F.sum(value).alias(f"{au}_sum"), F.count(value).alias(f"{au}_n"), F.max(value).alias(f"{au}_max")]
    return frames.groupBy("set_id").agg(*aggregates)


def merged_states(states: DataFrame) -> DataFrame:
    """One state per set from any number of them."""
    n, mean = F.sum("confident"), F.sum(F.col("conf_mean") * F.col("confident")) / F.sum("confident")
    # squares around the first mean of the group, so that large means do not swallow small spreads
    near = F.col("conf_mean") - F.col("conf_near")
    spread = F.sum("conf_spread") + F.sum(near * near * F.col("confident")) - F.pow(F.sum(near * F.col("confident")), 2) / n
    aggregates = [
        F.sum("total").alias("total"),
        F.sum("detected").alias("detected"),
        n.alias("confident"),
        mean.alias("conf_mean"),
        F.greatest(spread, F.lit(0.0)).alias("conf_spread"),
        F.min("conf_min").alias("conf_min"),
    ]
    for au in (c[:-4] for c in states.columns if c.endswith("_max")):
        aggregates += [F.sum(f"{au}_sum").alias(f"{au}_sum"), F.sum(f"{au}_n").alias(f"{au}_n"), F.max(f"{au}_max").alias(f"{au}_max")]
    start = states.groupBy("set_id").agg(F.min("conf_mean").alias("conf_near"))
    return states.join(start, "set_id").groupBy("set_id").agg(*aggregates)


def summary_of_states(states: DataFrame, threshold: float = MEAN_ACTIVE) -> DataFrame:
    """The columns of :func:`facial_summary` without its error, from one state per set."""
    detected = F.col("detected")

    def or_zero(value: Column) -> Column:
        return F.when(detected > 0, value).otherwise(F.lit(0.0))

    aus = [c[:-4] for c in states.columns if c.endswith("_max")]
    hits = [F.coalesce((F.col(f"{au}_sum") / F.col(f"{au}_n") > threshold).cast("int"), F.lit(0)) for au in aus]
    spread = F.when(F.col("confident") > 1, F.sqrt(F.col("conf_spread") / (F.col("confident") - 1)))
    return states.select(
        "set_id",
        (detected / F.col("total")).alias("detection_rate"),
        detected.alias("detection_count"),
        F.col("total").alias("total_frames"),
        or_zero(F.col("conf_mean")).alias("confidence_mean"),
        or_zero(spread).alias("confidence_std"),
        or_zero(F.col("conf_min")).alias("confidence_min"),
        *[F.col(f"{au}_max") for au in aus],
        sum(hits, F.lit(0)).alias("au_highly_active_count"),
    )


def long_units(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per detected frame and action unit: set_id, au, value."""
    pairs = ", ".join(f"'{au}', {au}_r" for au in EXERTION_AUS if f"{au}_r" in frames.columns)
    n = pairs.count("'") // 2
    return detected_frames(frames).select("set_id", *keep, F.expr(f"stack({n}, {pairs}) AS (au, value)"))


def unit_statistics(frames: DataFrame) -> DataFrame:
    """Full statistics of each action unit of each set: one row per set and unit with a value.

    All units of a frame stay in its row; only the statistics of a set are turned to one row per unit.
    """
    aus = [au for au in EXERTION_AUS if f"{au}_r" in frames.columns]
    detected = detected_frames(frames)
    parts = []
    for au in aus:
        v = F.col(f"{au}_r")
        parts += [
            F.struct(
                F.lit(au).alias("au"),
                F.avg(v).alias("mean"),
                F.stddev_pop(v).alias("std"),
                F.max(v).alias("max"),
                F.min(v).alias("min"),
                (F.max(v) - F.min(v)).alias("range"),
                F.skewness(v).alias("skew"),
                F.kurtosis(v).alias("kurtosis"),
                F.avg((v > 0.5).cast("int")).alias("activation_ratio"),
            )
        ]
    plain = detected.groupBy("set_id").agg(F.array(*parts).alias("units")).select("set_id", F.inline("units")).filter(F.col("mean").isNotNull())
    marks = {"q10": 0.10, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.90}
    known = detected.filter(F.col("set_id").isNotNull())
    ranks = wide_percentiles(known, "set_id", [f"{au}_r" for au in aus], marks)
    named = ranks.withColumn("au", F.element_at(F.array(*[F.lit(au) for au in aus]), F.col("c") + 1)).drop("c")
    ratio = F.when(F.col("q10") > 0.01, F.col("q90") / F.col("q10")).otherwise(F.lit(0.0))
    return plain.join(named, ["set_id", "au"]).withColumn("peak_baseline_ratio", ratio)


def overall_units(units: DataFrame) -> DataFrame:
    return units.groupBy("set_id").agg(
        F.avg("value").alias("au_overall_mean"),
        F.max("value").alias("au_overall_max"),
        F.stddev_pop("value").alias("au_overall_std"),
    )


# --- face strain from landmarks ------------------------------------------------

# Landmark numbers of the face mesh.
LEFT_EYE = {"top": 159, "bottom": 145, "outer": 33, "inner": 133}
RIGHT_EYE = {"top": 386, "bottom": 374, "outer": 362, "inner": 263}
BROWS = {"left": 70, "right": 300}
FACE = {"forehead": 10, "chin": 152}
LIPS = {"upper": 13, "lower": 14, "left": 61, "right": 291, "center": 0}
JAW = {"left": 234, "right": 454}
MESH_POINTS = sorted({*LEFT_EYE.values(), *RIGHT_EYE.values(), *BROWS.values(), *FACE.values(), *LIPS.values(), *JAW.values()})


def strain_metrics(points: Column, by_number: bool = False) -> list[Column]:
    """Five strain metrics from landmark points.

    ``points`` is the array of all points in mesh order or, with
    ``by_number``, a map from landmark number to point.
    """
    tiny = 1e-6

    def at(i: int) -> Column:
        return F.element_at(points, F.lit(i if by_number else i + 1))

    def gap(i: int, j: int) -> Column:
        return F.sqrt(F.pow(at(i)["x"] - at(j)["x"], 2) + F.pow(at(i)["y"] - at(j)["y"], 2))

    def openness(eye: dict) -> Column:
        return gap(eye["top"], eye["bottom"]) / (gap(eye["outer"], eye["inner"]) + tiny)

    height = gap(FACE["forehead"], FACE["chin"]) + tiny
    brow = (gap(BROWS["left"], LEFT_EYE["top"]) + gap(BROWS["right"], RIGHT_EYE["top"])) / 2
    chin = at(FACE["chin"])
    to = [{c: at(JAW[s])[c] - chin[c] for c in ("x", "y")} for s in ("left", "right")]
    dot = to[0]["x"] * to[1]["x"] + to[0]["y"] * to[1]["y"]
    cosine = dot / (gap(JAW["left"], FACE["chin"]) * gap(JAW["right"], FACE["chin"]) + tiny)
    corners = (at(LIPS["left"])["y"] + at(LIPS["right"])["y"]) / 2
    return [
        ((openness(LEFT_EYE) + openness(RIGHT_EYE)) / 2).alias("eye_aperture"),
        (brow / height).alias("brow_lowering"),
        (gap(LIPS["upper"], LIPS["lower"]) / (gap(LIPS["left"], LIPS["right"]) + tiny)).alias("lip_compression"),
        F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))).alias("jaw_angle"),
        ((at(LIPS["center"])["y"] - corners) / height).alias("mouth_corner_stretch"),
    ]


def strain_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("set_id").agg(
        F.max("eye_aperture").alias("max_eye_aperture"),
        F.avg("brow_lowering").alias("mean_brow_lowering"),
        F.max("lip_compression").alias("max_lip_compression"),
        F.max("jaw_angle").alias("max_jaw_angle"),
        F.min("mouth_corner_stretch").alias("min_mouth_corner_stretch"),
    )


def describe_columns(metrics: DataFrame, names: Sequence[str], frame: str = "frame") -> DataFrame:
    """Count, mean, std, min, quartiles and max of columns: one row per set and ``metric``.

    Sets without values of a metric, and rows without a set, have their rows too.
    """
    parts = [
        F.struct(
            F.lit(name).alias("metric"),
            F.count(name).alias("count"),
            F.avg(name).alias("mean"),
            F.stddev_samp(name).alias("std"),
            F.min(name).alias("min"),
            F.max(name).alias("max"),
        )
        for name in names
    ]
    plain = metrics.groupBy("set_id").agg(F.array(*parts).alias("metrics")).select("set_id", F.inline("metrics"))
    marks = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    key = F.coalesce(F.concat(F.lit("="), F.col("set_id").cast("string")), F.lit(""))  # no set is a key like any other
    ranks = wide_percentiles(metrics.withColumn("_key", key), "_key", names, marks, F.coalesce(block_of(frame), F.lit(0)))
    named = ranks.withColumn("metric", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)).drop("c")
    return plain.withColumn("_key", key).join(named, ["_key", "metric"], "left").drop("_key")
