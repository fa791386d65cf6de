"""Filling failed facial rows with means of similar sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .assemble import numeric_columns

# Grouping levels: bit 0 set where RPE is left out, bit 1 where exercise is.
BY_LIFT, BY_RPE = 1, 2


def failed_sets(features: DataFrame) -> DataFrame:
    return features.filter(F.col("error").isNotNull())


def donor_means(donors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Donor counts and means by exercise and RPE, by RPE, and by exercise.

    One pass over the donors for all three groupings. A set with several RPE
    labels is a donor for each of them but only once for its exercise.
    """
    once = F.col("_nth") == 0
    level = F.grouping_id()
    groups = donors.groupingSets([["_exercise", "_rpe"], ["_rpe"], ["_exercise"]], "_exercise", "_rpe")
    both = groups.agg(
        level.alias("_level"),
        F.count(F.lit(1)).alias("_all"),
        F.count(F.when(once, F.lit(1))).alias("_once"),
        F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_mean_all"),
        F.struct(*[F.avg(F.when(once, F.col(c))).alias(c) for c in columns]).alias("_mean_once"),
    )
    by_lift = F.col("_level") == BY_LIFT
    return both.select(
        "_exercise",
        "_rpe",
        "_level",
        F.when(by_lift, F.col("_once")).otherwise(F.col("_all")).alias("n"),
        F.when(by_lift, F.col("_mean_once")).otherwise(F.col("_mean_all")).alias("mean"),
    )


def _method(n1: Column, n2: Column, n3: Column) -> Column:
    rpe = F.col("_rpe").cast("string")
    same = F.concat(F.col("_exercise"), F.lit(" + RPE="), rpe)
    any_lift = F.concat(F.lit("RPE="), rpe, F.lit(" (any exercise)"))
    all_rpe = F.concat(F.col("_exercise"), F.lit(" (all RPE levels)"))
    return F.when(n1 >= 2, same).when(n2 >= 1, any_lift).when(n3 >= 1, all_rpe)


def impute_by_group_mean(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Fill every numeric column of failed rows from the nearest donor group.

    Donors share exercise and RPE (two or more), else RPE, else exercise. The
    three groupings are averaged in one pass and joined to the failed rows.
    ``labels``: video_name, exercise_type, rpe. Adds imputed,
    imputation_method and donor_count; rows without a label or donor stay.
    """
    columns = numeric_columns(features)
    features = cut_lineage(features, "features")
    tagged = labels.select("video_name", F.lower("exercise_type").alias("_exercise"), F.col("rpe").alias("_rpe"))
    failed = failed_sets(features)
    good = features.join(failed.select("video_name"), "video_name", "left_anti")
    rpes = F.array_sort(F.collect_set("_rpe"))
    per_set = tagged.groupBy("video_name", "_exercise").agg(rpes.alias("_rpes"))
    donors = good.join(per_set, "video_name").select(
        "_exercise", *columns, F.posexplode_outer("_rpes").alias("_nth", "_rpe")
    )
    means = cut_lineage(donor_means(donors.withColumn("_nth", F.coalesce("_nth", F.lit(0))), columns), "donor_means")
    first_label = tagged.groupBy("video_name").agg(F.min(F.struct("_exercise", "_rpe")).alias("_l"))
    wanted = failed.join(first_label, "video_name", "left").select(
        *features.columns, F.col("_l._exercise").alias("_exercise"), F.col("_l._rpe").alias("_rpe")
    )
    levels = {"both": (0, ["_exercise", "_rpe"]), "rpe": (BY_RPE, ["_rpe"]), "lift": (BY_LIFT, ["_exercise"])}
    for name, (level, by) in levels.items():
        side = means.filter(F.col("_level") == level).select(*by, F.col("n").alias(f"{name}_n"), F.col("mean").alias(f"{name}_mean"))
        wanted = wanted.join(side, by, "left")
    n1, n2, n3 = (F.coalesce(F.col(f"{level}_n"), F.lit(0)) for level in levels)
    means = F.when(n1 >= 2, F.col("both_mean")).when(n2 >= 1, F.col("rpe_mean")).when(n3 >= 1, F.col("lift_mean"))
    count = F.when(n1 >= 2, n1).when(n2 >= 1, n2).when(n3 >= 1, n3)
    picked = wanted.withColumns({"_means": means, "donor_count": count, "imputation_method": _method(n1, n2, n3)})
    hit = F.col("donor_count").isNotNull()
    cells = [
        F.when(hit, F.col(f"_means.{c}")).otherwise(F.col(c)).alias(c) if c in columns
        else F.when(~hit, F.col("error")).alias("error") if c == "error"
        else F.col(c)
        for c in features.columns
    ]
    filled = picked.select(*cells, hit.alias("imputed"), "imputation_method", "donor_count", "_exercise", "_rpe")
    untouched = features.filter(F.col("error").isNull()).select(
        *features.columns,
        F.lit(False).alias("imputed"),
        F.lit(None).cast("string").alias("imputation_method"),
        F.lit(None).cast("bigint").alias("donor_count"),
        F.lit(None).cast("string").alias("_exercise"),
        F.lit(None).cast(labels.schema["rpe"].dataType).alias("_rpe"),
    )
    return untouched.unionByName(filled).withColumnsRenamed({"_exercise": "exercise", "_rpe": "rpe"})


def imputation_log(imputed: DataFrame, n_features: int) -> DataFrame:
    return imputed.filter("imputed").select(
        "video_name", "exercise", "rpe", "donor_count", F.lit(n_features).alias("imputed_features"), "imputation_method"
    )


def imputation_summary(log: DataFrame) -> DataFrame:
    """Counts by exercise, by method and overall in one pass."""
    return (
        log.groupingSets([["exercise"], ["imputation_method"], []], "exercise", "imputation_method")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    )
