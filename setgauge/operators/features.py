"""Row-wise feature engineering: the 41 model columns and their variants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import movement_code
from .facial import EXERTION_AUS

AU_MAX_COLUMNS = [f"{au}_max" for au in EXERTION_AUS]
PAIRS = [("04", "07"), ("06", "12"), ("09", "10"), ("25", "26"), ("04", "06")]

# Fixed value: model columns in trained order.
MODEL_FEATURES = [
    "rep_count",
    "rep_change_s",
    "d_value",
    "detection_rate",
    "confidence_mean",
    "confidence_std",
    "confidence_min",
    *AU_MAX_COLUMNS,
    "au_highly_active_count",
    "Lift_Type_Code",
    "AU_sum",
    "AU_mean",
    "AU_max",
    "AU_std",
    *[f"AU{a}_{b}_interaction" for a, b in PAIRS],
    "quality_score",
    "confidence_cv",
    "body_face_strain",
    "d_value_x_AU_mean",
    "d_value_x_active_AUs",
    "avg_rep_duration",
    "tempo_x_facial_strain",
    "tempo_x_body_movement",
    "rep_count_sq",
    "strain_per_rep",
    "AU_sum_per_rep",
    "d_value_per_rep",
    "lift_type_x_reps",
]


def unit_aggregates(columns: Sequence[str], ddof: int = 1) -> dict[str, Column]:
    """Sum, mean, max and deviation over AU columns, skipping missing ones.

    No present value: sum 0, the others null. ``ddof`` 1 needs two values. The sums run over an array: written out per
    column, the generated method grew past what the JVM compiles, and every row was interpreted.
    """
    values = [F.col(c).cast("double") for c in columns]
    cells = F.array(*values)

    def added(term) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda total, v: total + F.coalesce(term(v), F.lit(0.0)))

    n = F.size(F.filter(cells, lambda v: v.isNotNull()))
    total = added(lambda v: v)
    mean = total / F.nullif(n, F.lit(0))
    spread = F.element_at(F.transform(F.array(mean), lambda m: added(lambda v: (v - m) * (v - m))), 1)
    return {
        "AU_sum": total,
        "AU_mean": mean,
        "AU_max": F.greatest(*values) if len(values) > 1 else values[0],
        "AU_std": F.when(n > ddof, F.sqrt(spread / F.nullif(n - ddof, F.lit(0)))),
    }


def unit_interactions(names: Sequence[str]) -> dict[str, Column]:
    have = set(names)
    return {
        f"AU{a}_{b}_interaction": F.col(f"AU{a}_max") * F.col(f"AU{b}_max")
        for a, b in PAIRS
        if {f"AU{a}_max", f"AU{b}_max"} <= have
    }


def engineer(df: DataFrame, ddof: int = 1) -> DataFrame:
    """All engineered columns whose inputs ``df`` has, training form."""
    have = set(df.columns)
    c = F.col
    aus = [a for a in AU_MAX_COLUMNS if a in have]
    step: dict[str, Column] = {}
    if aus:
        step |= unit_aggregates(aus, ddof) | unit_interactions(aus)
    if {"detection_rate", "confidence_mean"} <= have:
        step["quality_score"] = c("detection_rate") * c("confidence_mean")
    if {"confidence_mean", "confidence_std"} <= have:
        step["confidence_cv"] = c("confidence_std") / (c("confidence_mean") + 1e-6)
    if {"rep_change_s", "rep_count"} <= have:
        step["avg_rep_duration"] = c("rep_change_s") / (c("rep_count") + 1)
    if "rep_count" in have:
        step["rep_count_sq"] = c("rep_count") * c("rep_count")
        if "au_highly_active_count" in have:
            step["strain_per_rep"] = c("au_highly_active_count") / (c("rep_count") + 1)
        if "d_value" in have:
            step["d_value_per_rep"] = c("d_value") / (c("rep_count") + 1)
        if "Lift_Type_Code" in have:
            step["lift_type_x_reps"] = c("Lift_Type_Code") * c("rep_count")
    if {"d_value", "au_highly_active_count"} <= have:
        step["d_value_x_active_AUs"] = c("d_value") * c("au_highly_active_count")
    first = df.withColumns(step)
    have |= set(step)
    more: dict[str, Column] = {}
    if aus and "d_value" in have:
        more["body_face_strain"] = c("d_value") * c("AU_sum")
        more["d_value_x_AU_mean"] = c("d_value") * c("AU_mean")
    if "avg_rep_duration" in have:
        if aus:
            more["tempo_x_facial_strain"] = c("avg_rep_duration") * c("AU_sum")
        if "d_value" in have:
            more["tempo_x_body_movement"] = c("avg_rep_duration") * c("d_value")
    if aus and "rep_count" in have:
        more["AU_sum_per_rep"] = c("AU_sum") / (c("rep_count") + 1)
    return first.withColumns(more) if more else first


def enhanced(df: DataFrame) -> DataFrame:
    """Extra columns of the enhanced variant."""
    return df.withColumns(
        {
            "rep_intensity": F.col("rep_count") / (F.col("rep_change_s") + 1e-6),
            "confidence_mean_sq": F.col("confidence_mean") * F.col("confidence_mean"),
            "detection_rate_sq": F.col("detection_rate") * F.col("detection_rate"),
        }
    )


def three_factor(df: DataFrame, bar: str, strain: str, rom: str) -> DataFrame:
    return df.withColumns(
        {
            "bar_x_strain": F.col(bar) * F.col(strain),
            "bar_x_rom": F.col(bar) * F.col(rom),
            "strain_x_rom": F.col(strain) * F.col(rom),
        }
    )


def serving_features(df: DataFrame) -> DataFrame:
    """Features of one prediction per row with the serving defaults.

    Input: outer-joined bar, face and posture columns plus flags ``has_bar``,
    ``has_face``, ``has_posture``, ``posture_reps`` and ``movement``. Features
    the serving rules leave out are null here and 0 after alignment.
    """
    c, lit = F.col, F.lit
    aus = [a for a in AU_MAX_COLUMNS if a in df.columns]
    any_au = c("has_face") & (reduce(lambda a, b: a | b, [c(a).isNotNull() for a in aus]) if aus else lit(False))

    def face(name: str, default: float) -> Column:
        return F.when(any_au, c(name)).otherwise(lit(default))

    active = reduce(lambda a, b: a + b, [F.coalesce((c(a) > 2.0).cast("int"), lit(0)) for a in aus], lit(0))
    base = {
        "rep_change_s": F.when(c("has_bar"), F.coalesce(c("rep_change_s"), lit(0.0))).otherwise(lit(0.0)),
        "_bar_reps": F.when(c("has_bar"), F.coalesce(c("rep_count"), lit(0))).otherwise(lit(0)),
        "detection_rate": face("detection_rate", 0.5),
        "confidence_mean": face("confidence_mean", 0.5),
        "confidence_std": face("confidence_std", 0.1),
        "confidence_min": face("confidence_min", 0.3),
        "au_highly_active_count": F.when(any_au, active).otherwise(lit(0)),
        "d_value": F.when(c("has_posture"), c("d_value")).otherwise(lit(0.0)),
        "Lift_Type_Code": movement_code(c("movement")),
        **{k: F.when(any_au, F.coalesce(v, lit(0.0))).otherwise(lit(0.0)) for k, v in unit_aggregates(aus, 0).items()},
        **{k: F.when(any_au, v) for k, v in unit_interactions(aus).items()},
    }
    with_base = df.withColumns(base).withColumn(
        "rep_count",
        F.when((c("_bar_reps") == 0) & c("has_posture"), F.coalesce(c("posture_reps"), lit(0))).otherwise(c("_bar_reps")),
    )
    reps = c("rep_count")
    has_reps = reps > 0
    second = {
        "quality_score": c("detection_rate") * c("confidence_mean"),
        "confidence_cv": c("confidence_std") / (c("confidence_mean") + 1e-6),
        "body_face_strain": F.when(c("has_posture"), c("d_value") * c("AU_sum")),
        "d_value_x_AU_mean": F.when(c("has_posture"), c("d_value") * c("AU_mean")),
        "d_value_x_active_AUs": F.when(c("has_posture"), c("d_value") * c("au_highly_active_count")),
        "avg_rep_duration": F.when(has_reps, c("rep_change_s") / (reps + 1)),
        "rep_count_sq": F.when(has_reps, reps * reps),
        "AU_sum_per_rep": F.when(has_reps, c("AU_sum") / (reps + 1)),
        "d_value_per_rep": F.when(has_reps, c("d_value") / (reps + 1)),
        "strain_per_rep_serving": F.when(has_reps, (c("AU_sum") + c("d_value")) / (reps + 1)),
        "strain_per_rep": F.when(has_reps, c("au_highly_active_count") / (reps + 1)),
        "lift_type_x_reps": c("Lift_Type_Code") * reps,
        "extraction_success": c("has_bar") & c("has_face"),
    }
    out = with_base.withColumns(second)
    return out.withColumns(
        {
            "tempo_x_facial_strain": c("avg_rep_duration") * c("AU_sum"),
            "tempo_x_body_movement": c("avg_rep_duration") * c("d_value"),
        }
    ).drop("_bar_reps")


def min_max_weighted(df: DataFrame, fit_on: DataFrame, weights: dict[str, float], top: float = 10.0) -> DataFrame:
    """Scale columns to 0..``top`` by the ranges of ``fit_on``, then weight them."""
    ranges = fit_on.agg(
        *[f(n).cast("double").alias(f"{n}_{k}") for n in weights for k, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    out = df
    for n, w in weights.items():
        low, span = ranges[f"{n}_lo"], (ranges[f"{n}_hi"] - ranges[f"{n}_lo"]) or 1.0
        out = out.withColumn(f"{n}_scaled", (F.col(n) - low) / span * top * w)
    return out


def standardize(df: DataFrame, fit_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores by mean and population deviation of ``fit_on``."""
    stats = fit_on.agg(
        *[e for n in columns for e in (F.avg(n).alias(f"{n}_m"), F.stddev_pop(n).alias(f"{n}_s"))]
    ).first()
    return df.withColumns(
        {f"{n}_z": (F.col(n) - stats[f"{n}_m"]) / (stats[f"{n}_s"] or 1.0) for n in columns}
    )
