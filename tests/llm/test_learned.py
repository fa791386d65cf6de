"""The learned operators against loops: weights, counts, curve, normal equations, knots."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from setgauge.llm import quality, toxicity
from setgauge.llm.queries import fold_of

# 1: toxicity


def slow_weight(words, model):
    """Every pattern at every place by hand: the heaviest that begins there, unless inside a harmless phrase."""
    if not words:
        return 0.0
    text, heaviest, harmless = f" {' '.join(words)} ", {}, set()
    for at in range(len(text)):
        for phrase in model.exceptions:
            if text.startswith(f" {phrase} ", at):
                harmless |= set(range(at, at + len(phrase) + 1))
        found = [w for p, w in model.terms if text.startswith(p, at) and w > 0]
        if found:
            heaviest[at] = max(found)
    return sum(w for at, w in heaviest.items() if at not in harmless)


def test_weights_against_loops():
    rng = random.Random(2)
    parts = ["ab", "abc", "b", "ba", "cab", "bad", "fish"]
    for _ in range(500):
        terms = {f" {rng.choice(parts)} ": rng.choice([0.5, 2.0, 3.25]) for _ in range(3)} | {f" {rng.choice(parts)}": rng.choice([1.0, 2.5]) for _ in range(2)}
        model = toxicity.Model(tuple(terms.items()), tuple({" ".join(rng.choices(parts, k=2)) for _ in range(2)}))
        words = rng.choices(parts, k=rng.randrange(12))
        assert toxicity.weigh(words, model) == pytest.approx(slow_weight(words, model)), (words, model)


def test_term_counts_against_loops(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["alpha", "beta", "gamma", "deltas", "Épsilon", "zz"], k=rng.randrange(9))), rng.randrange(2)) for _ in range(200)]
    got = {r["term"]: (r["toxic"], r["other"]) for r in toxicity.count_terms(spark.createDataFrame(rows, "text string, label int").repartition(5)).collect()}
    want, kept = Counter(), {}
    for text, label in rows:
        words = toxicity.fold(text)
        kept.setdefault((toxicity.sketch(words), label), []).append(words)
    texts = Counter(label for _, label in kept)
    assert got[""] == (texts[1], texts[0])
    for (_, label), same in kept.items():
        if len({frozenset(w) for w in same}) == 1:  # else any of them may stand for the others
            want.update((t, label) for t in toxicity.candidates(same[0]))
    assert all(got[t][1 - label] >= n for (t, label), n in want.items())
    assert sum(map(sum, got.values())) >= sum(want.values())


def test_curve_is_where_the_loss_is_least():
    rng = np.random.default_rng(5)
    weight, n = rng.exponential(4, 800), rng.integers(5, 400, 800)
    label = (rng.random(800) < 1 / (1 + np.exp(3 - weight))).astype(float)
    at = np.array(toxicity.fit_curve(weight, n, label))
    x = np.column_stack([np.ones(800), *toxicity.features(weight, n)])
    p = 1 / (1 + np.exp(-x @ at))
    assert np.abs(x.T @ (p - label) + np.diag([1e-6, 1.0, 1.0]) @ at).max() < 1e-5


# 4: quality


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    stats = quality.measured(quality.labelled(docs, labels, "quality", fold_of(4) != 2, 500)).cache()
    rows = stats.collect()
    return docs, labels, stats, np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])


def test_normal_equations(labelled):
    _, _, stats, x, y = labelled
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a, b = quality.summed_products(stats.repartition(7), mean, scale)
    w, phase = quality.random_features()
    z = np.clip((x - mean) / scale, -6, 6)
    full = np.array([[np.sqrt(2 / quality.FEATURES) * np.cos(row @ w[:, k] + phase[k]) for k in range(quality.FEATURES)] + [1.0] for row in z])
    np.testing.assert_allclose(a, full.T @ full, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(b, full.T @ y, rtol=1e-8, atol=1e-8)


def test_knots_against_all_stretches():
    """The rising fit at a bin is the largest over its beginnings of the least mean over its ends."""
    rng = np.random.default_rng(7)
    for _ in range(50):
        n = rng.integers(1, 9, 12).astype(float)
        ones = np.floor(rng.random(12) * (n + 1))
        knots = quality.rising(n, ones, np.arange(12.0))
        mean = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        steps = [k for k in range(12) if k == 0 or want[k] - want[k - 1] > 1e-12]
        bounds = [*steps, 12]
        prior = ones.sum() / n.sum()
        shares = [(ones[a:b].sum() + prior) / (n[a:b].sum() + 1) for a, b in zip(bounds, bounds[1:])]
        assert [s for _, s in knots] == pytest.approx(shares)


def test_scores_follow_the_model(spark, labelled):
    docs, labels, *_ = labelled
    model = quality.fit(docs, labels, fold_of(4) != 2, rows=500)
    rows = docs.limit(40).collect()
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, docs.schema), model).collect()}
    places, shares = zip(*model.knots)
    for r in rows:
        x = quality.expand(np.array([quality.statistics(r["text"] or "")]), model.mean, model.scale)[0]
        assert got[r["doc_id"]] == pytest.approx(float(np.clip(np.interp(x @ np.array(model.weights), places, shares), 0, 1)))


def test_calibration_bins(labelled):
    """Knots of the raw scores of given rows, as counted by hand."""
    _, _, stats, x, y = labelled
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights = np.random.default_rng(1).normal(size=quality.FEATURES + 1) / 20
    raw = quality.expand(x, mean, scale) @ weights
    bins = np.clip(np.floor((raw + 0.5) * (quality.BINS / 2)), 0, quality.BINS - 1)
    used = np.unique(bins)
    want = quality.rising(*(np.array([f(bins == k) for k in used]) for f in (lambda m: float(m.sum()), lambda m: y[m].sum(), lambda m: raw[m].mean())))
    got = quality.calibration(stats, mean, scale, weights)
    assert len(want) < 2 or np.allclose(got, want)


def test_kept_rows_are_the_unlabelled_fold(labelled):
    docs, labels, *_ = labelled
    seen = quality.labelled(docs, labels, "quality", fold_of(4) != 2, 500)
    assert seen.where(fold_of(4) == 2).count() == 0 and seen.select("doc_id").distinct().count() <= 500
    assert seen.where(F.col("label").isNull()).count() == 0
