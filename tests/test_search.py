"""The staged search and concurrent fits against plain ones."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from setgauge.operators import model
from setgauge.session import concurrently

TARGET = "rpe"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = []
    for i in range(210):
        x, y = rng.random(), rng.random()
        made.append((f"s{i}", i % 3, 1 + 8 * x + (y > 0.5) + rng.gauss(0, 0.3), x, y, rng.random()))
    return spark.createDataFrame(made, "set_id string, fold int, rpe double, a double, b double, c double").repartition(3).cache()


def mae(fitted, rows):
    return fitted.transform(rows).select(F.avg(F.abs(F.col("prediction") - F.col(TARGET)))).first()[0]


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_every_beginning_of_the_trees(rows, loss):
    """One fit to six rounds serves each smaller number of rounds."""
    settings = model.Booster(loss, rounds=6, step=0.2, depth=3, bins=16)
    train, judge = rows.filter("fold <> 0"), rows.filter("fold = 0")
    staged = model.staged_errors(model.training_pipeline(["a", "b", "c"], TARGET, settings, "prediction").fit(train), judge, TARGET)
    assert len(staged) == 6
    for n in (1, 3, 6):
        short = model.training_pipeline(["a", "b", "c"], TARGET, model.replace(settings, rounds=n), "prediction").fit(train)
        assert math.isclose(staged[n - 1], mae(short, judge), rel_tol=1e-9)


def test_best_round():
    assert model.best_round([5, 4, 3, 3, 3.5, 2], 10) == 6
    assert model.best_round([5, 4, 3, 3, 3.5, 2], 2) == 3  # rounds 4 and 5 brought nothing, so 6 is not reached
    assert model.best_round([1.0], 1) == 1 and model.best_round([2, 2, 2], 9) == 1


def test_search_against_single_fits(rows):
    ranges = model.Ranges(rounds=(2, 6, 1), step=(0.1, 0.4), depth=(2, 4), bins=(16, 32))
    trials = model.drawn_trials(model.Booster("squared"), 2, draws=2, ranges=ranges, seed=3)
    got = {(r["trial"], r["rounds"]): r for r in model.search_settings(rows, TARGET, ["a", "b", "c"], trials, folds=3, patience=2).collect()}
    assert sorted(got) == [(i, d) for i, t in enumerate(trials) for d in t.draws]
    place = F.pmod(F.xxhash64(F.lit("validation"), F.col("set_id")), F.lit(10_000)) / 10_000
    for i, trial in enumerate(trials):
        for draw in trial.draws:
            best, errors = [], []
            for fold in range(3):
                inside = rows.filter(F.col("fold") != fold)
                fits = [
                    model.training_pipeline(["a", "b", "c"], TARGET, model.replace(trial.settings, rounds=n), "prediction").fit(inside.filter(place >= 0.15))
                    for n in range(1, draw + 1)
                ]
                n = model.best_round([mae(f, inside.filter(place < 0.15)) for f in fits], 2)
                best.append(n)
                errors.append(mae(fits[n - 1], rows.filter(F.col("fold") == fold)))
            assert math.isclose(got[i, draw]["mean_best_round"], sum(best) / 3)
            assert math.isclose(got[i, draw]["mean_mae"], sum(errors) / 3, rel_tol=1e-9)


def test_draws_stay_in_the_given_ranges():
    for trial in model.drawn_trials(model.DEFAULT_A, 60):
        s = trial.settings
        assert 0.008 <= s.step <= 0.05 and 6 <= s.depth <= 12 and 3 <= s.min_rows <= 20 and 200 <= s.bins <= 300
        assert 0.6 <= s.subsample <= 0.95 and 0.6 <= float(s.columns) <= 0.95
        assert all(1500 <= r <= 3000 and r % 100 == 0 for r in trial.draws) and s.rounds == max(trial.draws)
    assert model.drawn_trials(model.DEFAULT_A, 3) == model.drawn_trials(model.DEFAULT_A, 3)


def test_concurrent_fits_equal_serial_ones(rows):
    a, b = (model.Booster(loss, rounds=2, step=0.3, depth=3, bins=16) for loss in ("squared", "absolute"))
    together = model.fit_folds(rows, TARGET, ["a", "b", "c"], a, b, folds=3)
    for fold, fitted in enumerate(together):
        alone = model.fit_blend(rows.filter(F.col("fold") != fold), TARGET, ["a", "b", "c"], a, b)
        key = lambda m: sorted((r["set_id"], r["pred_a"], r["pred_b"], r["prediction"]) for r in m.predict(rows).collect())
        assert key(fitted) == key(alone)


def test_tasks_run_together_and_keep_their_order(spark):
    meet = threading.Barrier(3, timeout=60)

    def task(i):
        meet.wait()  # passes only if three run at once
        return i, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    got = concurrently(spark, [lambda i=i: task(i) for i in range(6)], width=3)
    assert [g[0] for g in got] == list(range(6)) and len({g[1] for g in got}) == 3
    with pytest.raises(ZeroDivisionError):
        concurrently(spark, [lambda: 1, lambda: 1 // 0])
