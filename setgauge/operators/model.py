"""Training, scoring and judging the two-model blend with MLlib."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import prediction_warnings
from ..functions.numbers import clip, half_point
from ..session import WIDTH, concurrently, cut_lineage, discard
from . import boosting, tracks
from .assemble import align_features
from .features import MODEL_FEATURES
from .reports import fitted_line, regression_metrics

# Blend weights, bins, limits.
WEIGHT_A, WEIGHT_B = 0.6, 0.4
RPE_MIN, RPE_MAX = 1.0, 10.0
BIN_EDGES = [0, 5, 7, 9, 11]
FINE_EDGES = [2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 10.5]
FOLDS, PLAIN_FOLDS = 7, 5
TOP_FEATURES = 10
#: Rows of all fits that run at the same time: a fit keeps its binned rows, some 300 bytes each, until it ends.
ROWS_AT_ONCE = 32_000_000
#: Values (rows times features) of a fit that runs in one task, which holds some 20 bytes for each; larger fits are spread by MLlib.
TASK_VALUES = 16_000_000
#: Bytes of vectors, as they are in memory, that a task of a fit reads at most; what MLlib keeps of the rows is about three times as large.
VECTOR_BYTES = 32 << 20


@dataclass(frozen=True)
class Booster:
    """Settings of one boosted-tree regressor.

    ``rounds`` defaults far below the 2600 of the original setting with a
    larger step: rounds run one after another, each over all data.
    """

    loss: str
    rounds: int = 150
    step: float = 0.1
    depth: int = 9
    subsample: float = 0.74
    columns: str = "0.64"
    bins: int = 216
    min_rows: int = 4
    seed: int = 42


DEFAULT_A, DEFAULT_B = Booster("squared"), Booster("absolute")


# --- splits ---------------------------------------------------------------------


def target_bin(target: Column, edges: Sequence[float] = tuple(BIN_EDGES)) -> Column:
    """Right-closed bins numbered from 0; null outside."""
    out = None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        hit = (target > low) & (target <= high)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def _shuffled(df: DataFrame, key: str, stratum: Column, seed: int) -> DataFrame:
    """Number rows of each stratum in hash order, without one task per stratum."""
    tagged = df.withColumn("_stratum", F.coalesce(stratum, F.lit(-1))).withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    return tracks.number_rows(tagged, ["_stratum"], ["_hash", key], F.shiftright("_hash", 52), "_nth", total="_size")


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_stratum", "_hash", "_nth", "_size")


def with_folds(df: DataFrame, key: str, target: str | None = None, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Adds ``fold``; sizes differ by at most one per target bin (or overall)."""
    stratum = F.lit(0) if target is None else target_bin(F.col(target))
    return _clean(_shuffled(df, key, stratum, seed).withColumn("fold", (F.col("_nth") % folds).cast("int")))


def with_split(df: DataFrame, key: str, shares: dict[str, float], stratum: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds ``part``: the named shares of each stratum, in hash order."""
    placed = _shuffled(df, key, F.lit(0) if stratum is None else stratum, seed)
    at = (F.col("_nth") + 0.5) / F.col("_size")
    names, upto, part = list(shares), 0.0, None
    for name in names[:-1]:
        upto += shares[name]
        part = F.when(at <= upto, name) if part is None else part.when(at <= upto, name)
    return _clean(placed.withColumn("part", part.otherwise(names[-1])))


# --- boosters ---------------------------------------------------------------------


class BoostedTrees(Estimator):
    """Fits an MLlib model: in one task where that holds the rows, otherwise by MLlib."""

    def __init__(self, settings: Booster, plain: GBTRegressor, key: str = "set_id"):
        super().__init__()
        self.settings, self.plain, self.key = settings, plain, key

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        width = len(dataset.select("scaled").first()[0]) if not dataset.isEmpty() else 0
        if self.plain.isSet("validationIndicatorCol") or not width or not fits_in_task(dataset.count(), width):
            return self.plain.fit(dataset)
        return boosting.fit(dataset, self.plain, self.settings, self.plain.getLabelCol(), self.key, width)


def fits_in_task(rows: int, features: int) -> bool:
    return rows * features <= TASK_VALUES


def booster(settings: Booster, target: str, prediction: str, validation: str | None = None) -> BoostedTrees:
    tree = GBTRegressor(
        featuresCol="scaled",
        labelCol=target,
        predictionCol=prediction,
        lossType=settings.loss,
        maxIter=settings.rounds,
        stepSize=settings.step,
        maxDepth=settings.depth,
        subsamplingRate=settings.subsample,
        featureSubsetStrategy=settings.columns,
        maxBins=settings.bins,
        minInstancesPerNode=settings.min_rows,
        seed=settings.seed,
        checkpointInterval=10,
        cacheNodeIds=True,
        maxMemoryInMB=512,
    )
    return BoostedTrees(settings, tree.setValidationIndicatorCol(validation) if validation else tree)


def training_pipeline(
    features: Sequence[str], target: str, settings: Booster, prediction: str, validation: str | None = None
) -> Pipeline:
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[vector, scale, booster(settings, target, prediction, validation)])


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with their features in one column, written once.

    A fit passes over its rows many times, and would assemble them in each pass. Files are compressed and have a bounded
    number of rows, and so have the tasks that read them.
    """
    made = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return cut_lineage(made.drop(*features), "vectors", max(1, VECTOR_BYTES // (8 * max(1, len(features)))), compression="zstd")


def fit_scaling(rows: DataFrame, features: Sequence[str]) -> PipelineModel:
    """The stages before a booster, fitted to rows of :func:`vectors`."""
    vector, scale, _ = training_pipeline(features, "", DEFAULT_A, "prediction").getStages()
    return PipelineModel([vector, scale.fit(rows)])


def fit_booster(
    rows: DataFrame, scaling: PipelineModel, target: str, settings: Booster, prediction: str, validation: str | None = None
) -> PipelineModel:
    """:func:`training_pipeline` fitted to rows of :func:`vectors`; fits to the same rows share their ``scaling``."""
    scaled = scaling.stages[-1].transform(rows)
    return PipelineModel([*scaling.stages, booster(settings, target, prediction, validation).fit(scaled)])


def fits_at_once(rows: DataFrame, width: int = WIDTH) -> int:
    """As many of ``width`` fits as their rows allow, at least one; one fit over many rows keeps all executors busy."""
    return max(1, min(width, ROWS_AT_ONCE // max(1, rows.count())))


def fit_width(rows: DataFrame, features: Sequence[str], width: int = WIDTH) -> int:
    """:func:`fits_at_once`; of fits that take one task each, as many as there are cores."""
    if fits_in_task(rows.count(), len(features)):
        return max(width, rows.sparkSession.sparkContext.defaultParallelism)
    return fits_at_once(rows, width)


def blend(a: Column, b: Column, low: float = RPE_MIN, high: float = RPE_MAX) -> Column:
    return clip(a * WEIGHT_A + b * WEIGHT_B, low, high)


@dataclass
class Blend:
    """Two fitted pipelines and their feature order."""

    model_a: PipelineModel
    model_b: PipelineModel
    features: list[str]
    metadata: dict

    def predict(self, aligned: DataFrame) -> DataFrame:
        """Adds pred_a, pred_b and the clipped blend ``prediction``."""
        passed = self.model_a.transform(aligned).drop("features", "scaled")
        passed = self.model_b.transform(passed).drop("features", "scaled")
        return passed.withColumn("prediction", blend(F.col("pred_a"), F.col("pred_b")))


def fit_blend(
    train: DataFrame,
    target: str = "rpe",
    features: Sequence[str] = MODEL_FEATURES,
    a: Booster = DEFAULT_A,
    b: Booster = DEFAULT_B,
    validation: str | None = None,
) -> Blend:
    rows = vectors(train, features)
    scaling = fit_scaling(rows, features)
    model_a = fit_booster(rows, scaling, target, a, "pred_a", validation)
    model_b = fit_booster(rows, scaling, target, b, "pred_b", validation)
    discard(rows)
    return Blend(model_a, model_b, list(features), {"booster_a": asdict(a), "booster_b": asdict(b), "target": target})


def fit_folds(
    df: DataFrame, target: str = "rpe", features: Sequence[str] = MODEL_FEATURES, a: Booster = DEFAULT_A, b: Booster = DEFAULT_B,
    folds: int = FOLDS, width: int = WIDTH,
) -> list[Blend]:
    """For each fold the models of the rows outside it; all 2 x ``folds`` fits share the executors."""
    rows = vectors(df, features)
    parts = [rows.filter(F.col("fold") != fold) for fold in range(folds)]
    scalings = concurrently(df.sparkSession, [lambda part=part: fit_scaling(part, features) for part in parts], width)
    tasks = [
        lambda part=part, scaling=scaling, one=one, name=name: fit_booster(part, scaling, target, one, name)
        for part, scaling in zip(parts, scalings)
        for one, name in ((a, "pred_a"), (b, "pred_b"))
    ]
    fitted = concurrently(df.sparkSession, tasks, fit_width(rows, features, width))
    discard(rows)
    metadata = {"booster_a": asdict(a), "booster_b": asdict(b), "target": target}
    return [Blend(x, y, list(features), dict(metadata)) for x, y in zip(fitted[::2], fitted[1::2])]


def out_of_fold(
    df: DataFrame, key: str, target: str = "rpe", features: Sequence[str] = MODEL_FEATURES, a: Booster = DEFAULT_A,
    b: Booster = DEFAULT_B, folds: int = FOLDS, keep: Sequence[str] = (),
) -> DataFrame:
    """Predictions of every row by the models that did not see its fold."""
    parts = []
    for fold, fitted in enumerate(fit_folds(df, target, features, a, b, folds)):
        scored = fitted.predict(df.filter(F.col("fold") == fold))
        parts.append(scored.select(key, "fold", target, "pred_a", "pred_b", "prediction", *keep))
    return reduce(DataFrame.unionByName, parts)


def blend_metrics(scored: DataFrame, target: str = "rpe") -> DataFrame:
    """MAE and R2 of both models and of the blend."""
    tables = [
        regression_metrics(scored, target, p).withColumn("model", F.lit(p)) for p in ("pred_a", "pred_b", "prediction")
    ]
    return reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True)
class Ranges:
    """What a search draws from: bounds of each setting; steps are drawn on a log scale."""

    rounds: tuple[int, int, int] = (1500, 3000, 100)
    step: tuple[float, float] = (0.008, 0.05)
    depth: tuple[int, int] = (6, 12)
    min_rows: tuple[int, int] = (3, 20)
    subsample: tuple[float, float] = (0.6, 0.95)
    columns: tuple[float, float] = (0.6, 0.95)
    bins: tuple[int, int] = (200, 300)


# The searched ranges, as given above.
SEARCHED = Ranges()


@dataclass(frozen=True)
class Trial:
    """One setting with its draws of rounds, and what came of each draw."""

    settings: Booster
    draws: tuple[int, ...]


def drawn_trials(base: Booster, trials: int, draws: int = 3, ranges: Ranges = SEARCHED, seed: int = 42) -> list[Trial]:
    """Random settings; each with ``draws`` numbers of rounds, in rising order."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        low, high = ranges.step
        settings = replace(
            base,
            step=low * (high / low) ** rng.random(),
            depth=rng.randint(*ranges.depth),
            min_rows=rng.randint(*ranges.min_rows),
            subsample=rng.uniform(*ranges.subsample),
            columns=f"{rng.uniform(*ranges.columns):.3f}",
            bins=rng.randint(*ranges.bins),
        )
        first, last, by = ranges.rounds
        rounds = sorted({rng.randrange(first, last + 1, by) for _ in range(draws)})
        out.append(Trial(replace(settings, rounds=rounds[-1]), tuple(rounds)))
    return out


def best_round(errors: Sequence[float], patience: int) -> int:
    """The round, from 1, of the least error up to the first stretch of ``patience`` rounds without a better one."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def staged_errors(fitted: PipelineModel, rows: DataFrame, target: str) -> list[float]:
    """Mean absolute error on ``rows`` of every beginning of the fitted trees, in one pass."""
    before = [stage for stage in fitted.stages[:-1] if stage.getOutputCol() not in rows.columns]  # rows of vectors have theirs
    prepared = PipelineModel(before).transform(rows)
    tree = fitted.stages[-1]
    if tree.getOrDefault("labelCol") != target:
        raise ValueError(f"fitted to {tree.getOrDefault('labelCol')}, not to {target}")
    return tree.evaluateEachIteration(prepared, "absolute")


def search_settings(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    trials: Sequence[Trial],
    key: str = "set_id",
    folds: int = FOLDS,
    validation: float = 0.15,
    patience: int = 150,
    width: int = WIDTH,
) -> DataFrame:
    """One row per trial and drawn number of rounds: settings, mean error over the folds, mean best round.

    A fold's training rows are split, by a hash of ``key``, into rows to learn from and rows to validate. A
    trial is fitted once per fold, to its largest draw. Every beginning of its trees is then evaluated on both
    the validation rows and the fold that was left out, in one pass each: a smaller draw of rounds is
    a beginning, and so is what early stopping would have left. The validation rows choose the round (the best one
    before ``patience`` rounds brought nothing, within the draw); the error is that of the fold, which chose nothing.
    """
    place = F.pmod(F.xxhash64(F.lit("validation"), F.col(key)), F.lit(10_000)) / 10_000
    tagged = vectors(df.withColumn("_validates", place < validation), features)
    learnt = [tagged.filter((F.col("fold") != fold) & ~F.col("_validates")) for fold in range(folds)]
    scalings = concurrently(df.sparkSession, [lambda part=part: fit_scaling(part, features) for part in learnt], width)

    alone = fits_in_task(tagged.count(), len(features))

    def errors(trial: Trial, fold: int) -> tuple[list[float], list[float]]:
        inside, outside = tagged.filter(F.col("fold") != fold), tagged.filter(F.col("fold") == fold)
        if alone and not learnt[fold].isEmpty():
            part = F.when(F.col("fold") == fold, 2).when(F.col("_validates"), 1).otherwise(0)
            scaled = scalings[fold].stages[-1].transform(tagged.filter(F.col("fold").isNotNull()))
            return boosting.staged(scaled, trial.settings, target, key, len(features), part, patience)
        fitted = fit_booster(learnt[fold], scalings[fold], target, trial.settings, "prediction")
        return staged_errors(fitted, inside.filter("_validates"), target), staged_errors(fitted, outside, target)

    def evaluate(trial: Trial, fold: int) -> list[tuple[int, float]]:
        chosen_by, judged_by = errors(trial, fold)
        known = not any(map(math.isnan, chosen_by))  # a small fold may have no rows to validate
        rounds = [best_round(chosen_by[:draw], patience) if known else draw for draw in trial.draws]
        return [(r, judged_by[r - 1]) for r in rounds]

    tasks = [lambda t=t, fold=fold: evaluate(t, fold) for t in trials for fold in range(folds)]
    results = concurrently(df.sparkSession, tasks, fit_width(tagged, features, width))
    discard(tagged)
    rows = []
    for i, trial in enumerate(trials):
        own = results[i * folds : (i + 1) * folds]
        for k, draw in enumerate(trial.draws):
            judged = [r[k] for r in own if not math.isnan(r[k][1])]  # empty folds say nothing
            best, errors = zip(*judged) if judged else ((math.nan,), (math.nan,))
            s = trial.settings
            rows.append((i, draw, s.step, s.depth, s.min_rows, s.subsample, float(s.columns), s.bins, sum(best) / len(best), sum(errors) / len(errors)))
    names = "trial int, rounds int, step double, depth int, min_rows int, subsample double, columns double, bins int, mean_best_round double, mean_mae double"
    return df.sparkSession.createDataFrame(rows, names)


def importances(fitted: Sequence[Blend], spark: SparkSession) -> DataFrame:
    """Normalised importances of both models, blended and averaged over fits."""
    n = len(fitted[0].features)
    sums = [[0.0] * n, [0.0] * n]
    for one in fitted:
        for at, model in enumerate((one.model_a, one.model_b)):
            values = model.stages[-1].featureImportances.toArray()
            total = float(values.sum()) or 1.0
            sums[at] = [s + float(v) / total / len(fitted) for s, v in zip(sums[at], values)]
    rows = [(f, WEIGHT_A * x + WEIGHT_B * y, x, y) for f, x, y in zip(fitted[0].features, *sums)]
    return spark.createDataFrame(rows, "feature string, importance double, importance_a double, importance_b double")


def top_importances(table: DataFrame, count: int = TOP_FEATURES) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(count)


# --- calibration --------------------------------------------------------------------


def _line(df: DataFrame, y: str, x: str) -> tuple[float, float]:
    row = fitted_line(df, y, x).first()
    return (row["slope"] or 0.0), (row["intercept"] or 0.0)


def calibrate(scored: DataFrame, fit_on: DataFrame, target: str, prediction: str) -> DataFrame:
    """Adds ``calibrated``: the line truth ~ prediction of ``fit_on``."""
    slope, intercept = _line(fit_on, target, prediction)
    return scored.withColumn("calibrated", F.col(prediction) * slope + intercept)


def correct_bias(scored: DataFrame, fit_on: DataFrame, target: str, prediction: str, low: float = 3.0, high: float = 10.0) -> DataFrame:
    """Adds ``corrected``: prediction plus its expected residual, mixed with the
    smaller of corrected and raw, clipped."""
    with_residual = fit_on.withColumn("_residual", F.col(target) - F.col(prediction))
    slope, intercept = _line(with_residual, "_residual", prediction)
    shifted = F.col(prediction) * (1 + slope) + intercept
    return scored.withColumn("corrected", clip(0.75 * shifted + 0.25 * F.least(shifted, F.col(prediction)), low, high))


# --- scoring ---------------------------------------------------------------------------


def confidence(rate: Column, a: Column, b: Column, complete: Column) -> Column:
    agreement = F.greatest(F.lit(0.5), 1.0 - F.abs(a - b) / 10.0)
    value = F.coalesce(rate, F.lit(0.8)) * agreement * F.when(complete, 1.0).otherwise(0.7)
    return F.bround(value, 2)


def score_sets(serving: DataFrame, fitted: Blend, key: str = "set_id") -> DataFrame:
    """Predictions of all sets at once, rounded to half points, with
    confidence and warnings."""
    keep = [key, "extraction_success", "has_bar", "has_face", "has_posture"]
    kept = serving.withColumn("_rate", F.col("detection_rate"))
    aligned = align_features(kept, fitted.features, [*keep, "_rate"])
    scored = fitted.predict(aligned)
    return scored.select(
        key,
        half_point(F.col("prediction")).alias("predicted_rpe"),
        confidence(F.col("_rate"), F.col("pred_a"), F.col("pred_b"), F.col("extraction_success")).alias("confidence"),
        F.round("pred_a", 2).alias("pred_a"),
        F.round("pred_b", 2).alias("pred_b"),
        prediction_warnings(F.col("_rate"), F.col("has_bar"), F.col("has_face"), F.col("has_posture")).alias("warnings"),
    )


# --- bundles -----------------------------------------------------------------------------


def save_bundle(fitted: Blend, folder: str, version: str, spark: SparkSession, metrics: dict | None = None) -> None:
    base = f"{folder}/{version}"
    fitted.model_a.write().overwrite().save(f"{base}/model_a")
    fitted.model_b.write().overwrite().save(f"{base}/model_b")
    metadata = {
        **fitted.metadata,
        "version": version,
        "feature_columns": fitted.features,
        "n_features": len(fitted.features),
        "ensemble_weights": {"a": WEIGHT_A, "b": WEIGHT_B},
        "cv_performance": metrics or {},
    }
    row = spark.createDataFrame([(version, json.dumps(metadata))], "version string, metadata string")
    row.coalesce(1).write.mode("append").json(f"{folder}/metadata")


def bundle_versions(folder: str, spark: SparkSession) -> DataFrame:
    return spark.read.schema("version string, metadata string").json(f"{folder}/metadata")


def load_bundle(folder: str, spark: SparkSession, version: str | None = None) -> Blend:
    """The named version, or the latest one."""
    saved = bundle_versions(folder, spark)
    chosen = saved.filter(F.col("version") == version) if version else saved
    row = chosen.orderBy(F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"no model bundle {version or ''} in {folder}")
    metadata = json.loads(row["metadata"])
    base = f"{folder}/{row['version']}"
    return Blend(
        PipelineModel.load(f"{base}/model_a"), PipelineModel.load(f"{base}/model_b"), metadata["feature_columns"], metadata
    )
