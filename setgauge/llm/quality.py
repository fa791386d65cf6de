"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text are standardised and mapped to cosines of random projections, whose
products approximate a Gaussian kernel. Each task sums the products of its labelled rows into normal
equations, Spark adds the sums up, and one small system gives the ridge weights. On a quarter of the
labelled rows that the weights have not seen, raw scores are counted into bins, and pooling adjacent
violators makes them a rising curve of label shares, which calibrates the score.

``FIT_ROWS`` labelled rows at most are learned from, chosen by a hash of their id. All texts are scored whole.

Cases: a null text is an empty one and scores by its statistics; repeated rows give repeated rows;
without two kinds of labels every score is the share of label 1 (0.5 without any); an empty table
gives an empty table; other columns are ignored. Of several labels of a document the highest counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setgauge.llm.common import chunks, map_texts
from setgauge.llm.toxicity import labelled

FIT_ROWS = 20_000
#: Random features, width of the kernel in standard deviations, ridge, seed.
FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1.0, 7
BINS = 200
WORD = re.compile(r"\S+").findall
LETTERS = re.compile(r"[^\W\d_]")
#: Signs whose share is a statistic of its own.
SIGNS = ".,!?|#$%&*"
NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "other", "lines", "short_lines", "line_repeats", "distinct_words",
    "top_word", "next_repeats", "ends_plain", "squeezed", "capital_words", "shout_words", "odd_ends", *(f"sign_{i}" for i in range(len(SIGNS))),
)


def statistics(text: str) -> list[float]:
    """Statistics of one whole text, each of moderate size."""
    n = len(text)
    words = WORD(text)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    k, m = max(1, len(words)), max(1, n)
    raw = text.encode("utf-8", "surrogatepass")
    ascii_upper = sum(raw.count(c) for c in UPPER)
    blank = raw.count(b" ") + raw.count(b"\n") + raw.count(b"\t")
    digit = sum(raw.count(c) for c in DIGITS)
    signs = [text.count(c) for c in SIGNS]
    size = max(1, len(raw))
    capital = sum(1 for w in words if w[0].isupper())
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ends = sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,"))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), min(30.0, sum(map(len, words)) / k), ascii_upper / m, digit / m, blank / m,
        (n - blank - digit - sum(c for c in signs)) / m, float(np.log1p(len(lines))), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), len(counts) / k, counts.most_common(1)[0][1] / k if counts else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / k, float(text.rstrip()[-1:] in ".!?"), len(zlib.compress(raw, 1)) / size if raw else 1.0,
        capital / k, shouted / k, ends / k, *(c / m for c in signs),
    ]


UPPER = [bytes([c]) for c in range(65, 91)]
DIGITS = [bytes([c]) for c in range(48, 58)]


@dataclass(frozen=True)
class Model:
    """mean, scale of the statistics; weights over the features and a constant; rising (raw, score) knots."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    knots: tuple[tuple[float, float], ...]

    def score(self, raw: np.ndarray) -> np.ndarray:
        at, value = zip(*self.knots)
        return np.interp(raw, at, value)


def random_features(seed: int = SEED, n: int = FEATURES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Projections and phases of the kernel; the same for each task."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(NAMES), n)) / width, rng.uniform(0, 2 * np.pi, n)


def expand(stats: np.ndarray, mean, scale) -> np.ndarray:
    """Standardised statistics as random Fourier features, and a constant."""
    w, b = random_features()
    z = np.clip((stats - np.array(mean)) / np.array(scale), -6, 6)
    return np.column_stack([np.sqrt(2.0 / FEATURES) * np.cos(z @ w + b), np.ones(len(z))])


STATISTICS = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("part", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def measured(rows: DataFrame) -> DataFrame:
    """(label, part, x) of labelled rows; part 0 is kept for the calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("part"), pa.array(x, pa.list_(pa.float64()))], names=["label", "part", "x"])

    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)).cast("int")
    return rows.select(F.col("label").cast("double"), part.alias("part"), "text").mapInArrow(run, STATISTICS)


def summed_products(stats: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations: each task sums its own rows, Spark sums the tasks, entry by entry."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = expand(np.array(batch.column("x").to_pylist()), mean, scale)
                y = np.array(batch.column("label").to_pylist())
                total += x.T @ np.column_stack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["entry", "value"])

    sums = stats.mapInArrow(run, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()  # FEATURES squared
    total = np.zeros((size, size + 1))
    for entry, value in sums:
        total[entry // (size + 1), entry % (size + 1)] = value
    return total[:, :size], total[:, size]


def rising(count: np.ndarray, ones: np.ndarray, at: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Pool adjacent violators: (place, share) knots that rise, from bins with counts; a light prior towards the mean."""
    prior = ones.sum() / count.sum()
    pools: list[list[float]] = []
    for n, one, x in zip(count, ones, at):
        pools.append([n, one, x * n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, one2, x2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + one2, pools[-1][2] + x2]
    return tuple((x / n, (one + prior) / (n + 1)) for n, one, x in pools)


def calibration(stats: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Knots from the raw scores of rows unseen so far, counted into bins by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = expand(np.array(batch.column("x").to_pylist()), mean, scale) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("label")], names=["raw", "label"])

    place = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    bins = stats.mapInArrow(run, "raw double, label double").groupBy(place).agg(F.count("*").alias("n"), F.sum("label").alias("ones"), F.avg("raw").alias("at"))
    found = sorted(bins.collect())  # BINS rows at most
    if not found:
        return ((0.0, 0.0), (1.0, 1.0))
    knots = rising(*(np.array([r[i] for r in found], float) for i in (1, 2, 3)))
    return knots if len(knots) > 1 else (knots[0], (knots[0][0] + 1e-6, knots[0][1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    stats = measured(labelled(docs, labels, label, learn, rows)).persist()
    try:
        many = stats.agg(
            F.count("*").alias("n"),
            F.sum("label").alias("ones"),
            *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(NAMES))],
            *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(NAMES))],
        ).first()
        if not many["n"] or many["ones"] in (0, many["n"]):
            share = many["ones"] / many["n"] if many["n"] else 0.5
            return Model((0.0,) * len(NAMES), (1.0,) * len(NAMES), (0.0,) * (FEATURES + 1), ((0.0, share), (1.0, share)))
        mean = np.array([many[f"m{i}"] for i in range(len(NAMES))])
        scale = np.array([max(many[f"s{i}"], 1e-6) for i in range(len(NAMES))])
        a, b = summed_products(stats.where("part <> 0"), mean, scale)
        ridge = RIDGE * np.eye(FEATURES + 1)
        ridge[-1, -1] = 1e-6
        weights = np.linalg.solve(a + ridge, b)
        knots = calibration(stats.where("part = 0"), mean, scale, weights)
        a2, b2 = summed_products(stats.where("part = 0"), mean, scale)
        weights = np.linalg.solve(a + a2 + ridge, b + b2)
        return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()), knots)
    finally:
        stats.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, raw, score) of whole texts."""

    def work(texts):
        if not texts:
            return {"raw": [], "score": []}
        raw = expand(np.array([statistics(t) for t in texts]), model.mean, model.scale) @ np.array(model.weights)
        return {"raw": raw.tolist(), "score": np.clip(model.score(raw), 0, 1).tolist()}

    return map_texts(docs, work, T.StructType([T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType())]))
