"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, letters of other scripts that look like Latin ones, digits and
signs used as letters. The words of the folded text are searched for whole words and word beginnings
of the lexicon; a word counts its heaviest match once, and not at all inside an exception phrase.
The summed weight, as it is and per 100 words, gives the score through a logistic curve.

The lexicon has a short fixed part and terms learned from labelled rows: words and word beginnings
that are in significantly more toxic than other texts. ``FIT_ROWS`` labelled rows at most, chosen by
a hash of their id, are learned from; near copies among them count once. Everything else runs over
all texts and whole texts.

Cases: a null text is an empty one and scores as a text without matches; repeated rows give repeated
rows; without usable labels the fixed lexicon and a fixed curve hold; an empty table gives an empty
table; other columns are ignored. Of several labels of a document the highest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setgauge.llm.common import chunks, map_texts

#: Most labelled rows that are learned from.
FIT_ROWS = 20_000
#: Most learned terms; of more, those with the most evidence stay.
MOST_TERMS = 5_000
#: Terms that a task counts before it passes them on.
MOST_COUNTED = 200_000
#: A term must be in so many toxic texts, and so many times as often as in others (natural log).
LEAST_TEXTS, LEAST_LOG_ODDS, LEAST_Z = 4, 2.0, 3.5
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(4, 9)
#: Words that are insults wherever they stand, with the weight of a strong term.
FIXED_TERMS = ("idiot", "moron", "stupid", "loser", "clown", "scum", "trash", "worthless", "pathetic", "disgusting")
FIXED_WEIGHT = 6.0
#: Phrases in which a term is harmless.
EXCEPTIONS = ("clown fish", "trash can", "trash bag", "trash bin", "pond scum", "idiot proof", "idiot board", "sore loser", "stupid simple")
#: Curve used where no label can be learned from: intercept, log weight, log weight per 100 words.
FIXED_CURVE = (-4.0, 2.0, 1.0)

#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKE = dict(zip("аеорсухіѕјԁһӏвкмнтαεικνορτυχωɡ", "aeopcyxisjdhlbkmhtaeikvoptuxwg"))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
FULL_WIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): str(i) for i in range(10)}
FOLD = str.maketrans(LOOK_ALIKE | DIGITS | {k: DIGITS.get(v, v) for k, v in FULL_WIDTH.items()} | dict.fromkeys("​‌‍­﻿"))
SIGN = re.compile(r"[@$!|€](?=[^\W_])")
WORD = re.compile(r"[^\W\d_]+").findall


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    low = text.lower().translate(FOLD)
    if "!" in low or "$" in low or "@" in low or "|" in low or "€" in low:
        low = SIGN.sub(lambda m: SIGNS[m[0]], low)
    return WORD(low)


@dataclass(frozen=True)
class Model:
    """terms: (pattern, weight); a pattern begins with a blank and, for a whole word, ends with one."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = FIXED_CURVE


@lru_cache(maxsize=4)
def automaton(terms: tuple, exceptions: tuple):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in exceptions:
        machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
    for pattern, weight in terms:
        machine.add_word(pattern, (len(pattern), weight))
    machine.make_automaton()
    return machine


def weigh(words: list[str], model: Model) -> float:
    """Summed weight of the matched words."""
    if not words or not (model.terms or model.exceptions):
        return 0.0
    heaviest: dict[int, float] = {}
    harmless = []
    for end, (length, weight) in automaton(model.terms, model.exceptions).iter(f" {' '.join(words)} "):
        start = end - length + 1
        if weight is None:
            harmless.append((start, end))
        elif weight > heaviest.get(start, 0.0):
            heaviest[start] = weight
    if harmless:
        heaviest = {at: w for at, w in heaviest.items() if not any(a <= at < b for a, b in harmless)}
    return math.fsum(heaviest.values())


def weighed(texts: Iterable[str], model: Model) -> tuple[list[int], list[float]]:
    """Number of words and weight of each text; the words of one text are held at a time."""
    n, weight = [], []
    for text in texts:
        words = fold(text)
        n.append(len(words))
        weight.append(weigh(words, model))
    return n, weight


def features(weight, n):
    return np.log1p(weight), np.log1p(100.0 * np.asarray(weight) / np.maximum(n, 1))


def curve(weight: list[float], n: list[int], at: tuple) -> list[float]:
    a, b = features(np.array(weight, float), np.array(n, float))
    return (1.0 / (1.0 + np.exp(-np.clip(at[0] + at[1] * a + at[2] * b, -40, 40)))).tolist()


MEASURED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("weight", T.DoubleType())])


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, weight)."""

    def work(texts):
        n, weight = weighed(texts, model)
        return {"n_words": n, "weight": weight}

    return map_texts(docs, work, MEASURED)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, weight, score) for whole texts; the score is between 0 and 1."""

    def work(texts):
        n, weight = weighed(texts, model)
        return {"n_words": n, "weight": weight, "score": curve(weight, n, model.curve)}

    return map_texts(docs, work, T.StructType([*MEASURED.fields, T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``below``, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, weight = weighed((t.as_py() or "" for t in batch.column("text")), model)
            scores = curve(weight, n, model.curve)
            yield batch.filter(pa.array([x < below for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sketch(words: list[str]) -> int:
    """Least hash of the five-word shingles: mostly equal for near copies."""
    if not words:
        return 0
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1


def candidates(words: list[str]) -> set[str]:
    distinct = set(words)
    return {f" {w} " for w in distinct} | {f" {w[:n]}" for w in distinct for n in BEGINNINGS if len(w) >= n}


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of ``rows`` labelled rows at most, chosen by a hash of the id.

    ``learn`` says which rows of the labels may be seen. The chosen ids are bounded by ``rows``, so they
    may be broadcast, and the texts are not shuffled.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, toxic, other): in how many distinct texts of each kind; a row without a term has all texts."""
    sketched = T.StructType([T.StructField("key", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType()))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keys, terms = [], []
            for text in batch.column("text"):
                words = fold(text.as_py())
                keys.append(sketch(words))
                terms.append(pa.array(sorted(set(words)), pa.string()))
            ends = np.cumsum([0, *map(len, terms)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], pa.string()), *terms]))
            columns = [pa.array(keys, pa.int64()), batch.column("label").cast(pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "terms"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def rows():
            for label, counted in counts.items():
                terms = list(counted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([counted[t] if label else 0 for t in terms], pa.int64()), pa.array([0 if label else counted[t] for t in terms], pa.int64())],
                    names=["term", "toxic", "other"],
                )
                counted.clear()

        for batch in batches:
            for label, words in zip(batch.column("label").to_pylist(), batch.column("terms")):
                counted = counts[int(label >= 1)]
                counted.update(candidates(words.as_py()))
                counted[""] += 1
                if len(counts[0]) + len(counts[1]) > MOST_COUNTED:
                    yield from rows()
        yield from rows()

    once = rows.select("text", "label").mapInArrow(first, sketched).dropDuplicates(["key", "label"])
    return once.mapInArrow(second, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_terms(rows: DataFrame) -> tuple[tuple[str, float], ...]:
    """At most MOST_TERMS terms with their log odds as weights, and the fixed ones."""
    fixed = {f" {w} ": FIXED_WEIGHT for w in FIXED_TERMS}
    counted = count_terms(rows).persist()
    try:
        every = counted.where("term = ''").first()
        if every is None or not every["toxic"] or not every["other"]:
            return tuple(sorted(fixed.items()))
        t, c = F.col("toxic") + 0.5, F.col("other") + 0.5
        odds = F.log(t / (every["toxic"] + 1)) - F.log(c / (every["other"] + 1))
        z = odds / F.sqrt(1 / t + 1 / c)
        found = (
            counted.where(F.col("term") != "")
            .select("term", odds.alias("weight"), z.alias("z"), "toxic")
            .where((F.col("toxic") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_LOG_ODDS) & (F.col("z") >= LEAST_Z))
            .orderBy(F.desc("z"), "term")
            .limit(MOST_TERMS)
            .collect()
        )
    finally:
        counted.unpersist()
    return tuple(sorted((fixed | {r["term"]: r["weight"] for r in found}).items()))


def fit_curve(weight: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve by damped Newton steps with a light ridge."""
    if len(set(label.tolist())) < 2:
        return FIXED_CURVE
    x = np.column_stack([np.ones(len(label)), *features(weight, n)])
    ridge = np.diag([1e-6, 1.0, 1.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0, z).sum() - label @ z + at @ ridge @ at / 2)

    at = np.zeros(3)
    for _ in range(100):  # the loss is convex; a step is halved until it falls
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (label - p) - ridge @ at)
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-10:
            step = step / 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in at)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Lexicon and curve from the labelled rows that ``learn`` admits.

    Terms are learned from three quarters of the rows first, to fit the curve on the last quarter, which
    those terms have not seen; then from all.
    """
    seen = labelled(docs, labels, label, learn, rows).persist()
    try:
        quarter = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4)) == 0
        early = Model(learn_terms(seen.where(~quarter)))
        measured = measure(seen.where(quarter), early)
        held = seen.select("doc_id", "label").distinct().join(measured, "doc_id").select("weight", "n_words", "label").collect()  # rows / 4 at most
        at = fit_curve(*(np.array([r[i] for r in held], float) for i in range(3))) if held else FIXED_CURVE
        return Model(learn_terms(seen), EXCEPTIONS, at)
    finally:
        seen.unpersist()
