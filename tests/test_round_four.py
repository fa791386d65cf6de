"""What bounded the large runs: compiled method sizes, rows per task, fits at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from setgauge.operators import assemble as asm
from setgauge.operators import features, model, signals, tracks

#: Methods above this many bytes are never compiled by the JVM.
HUGE = 8000


def _largest_method(df) -> int:
    found = df._jdf.queryExecution().debug().codegenToSeq()
    return max((found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())), default=0)


@pytest.fixture
def wide(spark):
    plain = ["rep_count", "rep_change_s", "d_value", "detection_rate", "confidence_mean", "confidence_std", "confidence_min", "au_highly_active_count", "Lift_Type_Code"]
    cells = [(F.col("id") % (i + 3)).cast("double").alias(c) for i, c in enumerate([*plain, *features.AU_MAX_COLUMNS])]
    return spark.range(50).select(F.col("id").alias("set_id"), *cells)


def test_feature_plans_are_compiled(wide):
    aligned = asm.align_features(features.engineer(wide), features.MODEL_FEATURES)
    assert _largest_method(aligned) < HUGE
    assert _largest_method(asm.bucket_digests(aligned, "set_id", features.MODEL_FEATURES, 16)) < HUGE


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tracks, "ROWS_PER_TASK", 10)
    frames = spark.range(95).select(F.lit(1).alias("set_id"), F.col("id").alias("pos"))
    assert tracks.dealt(frames, ["pos"], 95).rdd.getNumPartitions() == 10
    assert tracks.dealt(frames, ["pos"], None) is frames
    signal = frames.withColumn("y", F.when(F.col("pos") % 3 > 0, F.col("pos") * 0.5))
    plain, many = (signals.fill_gaps(signal, "y", rows=n).orderBy("pos").collect() for n in (None, 95))
    assert plain == many


def test_fits_share_rows_and_scaling(spark, monkeypatch):
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 3 + 0.5).alias("t"))
    fitted = model.fit_blend(rows, "t", ["a", "b"], model.Booster("squared", rounds=1, depth=2, bins=8), model.Booster("absolute", rounds=1, depth=2, bins=8))
    assert fitted.model_a.stages[1].uid == fitted.model_b.stages[1].uid
    assert fitted.predict(rows).count() == 60
    monkeypatch.setattr(model, "ROWS_AT_ONCE", 130)
    assert [model.fits_at_once(rows), model.fits_at_once(rows.limit(0)), model.fits_at_once(rows.union(rows).union(rows))] == [2, 4, 1]


def test_a_fit_reads_its_rows_in_bounded_pieces(spark, monkeypatch):
    """However large the files of vectors are, a task gets so many bytes of them, and no row is lost."""
    monkeypatch.setattr(model, "VECTOR_BYTES", 1 << 20, raising=False)
    names = [f"f{i}" for i in range(12)]
    cells = [((F.col("id") * (i + 3)) % 1009 + 0.5).alias(c) for i, c in enumerate(names)]
    rows = model.vectors(spark.range(0, 60_000, 1, 1).select(F.col("id").alias("set_id"), (F.col("id") % 19 / 2.0).alias("rpe"), *cells), names)
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 60_000 and max(held) < 15_000
    assert rows.agg(F.countDistinct("set_id")).first()[0] == 60_000
    fitted = model.fit_booster(rows, model.fit_scaling(rows, names), "rpe", model.Booster("squared", rounds=1, depth=2, bins=8), "pred_a")
    assert fitted.transform(rows.select("set_id", "rpe", *[F.lit(1.0).alias(c) for c in names])).count() == 60_000
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) > 1 << 20
