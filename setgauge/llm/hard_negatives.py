"""Hard negatives by vertical scans of dimensions.

Vectors are cut to integers, floor(scale * x), so scores are exact. Rows lie in blocks of ``BLOCK``, one column
per dimension. An anchor reads a block's columns in descending order of its own magnitudes, ``STEP`` at a time;
what the unread columns can still add lies between the sums of their least and largest contributions (the
block's minimum and maximum of a dimension times the anchor's component). A candidate whose bounds leave no place
for it loses its bit; the scores of the others become exact with the last column.

Two passes of anchors, in groups, over blocks:

* positives: an anchor meets the blocks of its own label. Bits go where the upper bound lies below the
  ``positives``-th largest lower bound.
* negatives: every anchor meets every block. Each distinct score of its positives opens a window of scores; bits
  go where no window can be reached, or where the wanted number of sure rows of the window lie above.

Of each pass only the best few rows per anchor (or window) and block leave a task. A label with a third of all
rows is many blocks and groups, by a hash of vec_id; small labels share blocks. All anchors against all rows is
work that grows with anchors x rows, in blocks; the bounds only shorten it.

Cases: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Vectors of
different lengths do not meet; vectors without components have the score 0. A row that repeats vec_id, label and
vector counts once; rows of one vec_id that differ are rows of their own, but neither positive nor negative of each
other. Ties go to the smaller vec_id. Components beyond 2^28 after scaling count as 2^28, so scores of up to 127
such dimensions fit a long. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setgauge.llm.common import cut, discard

#: Rows of a block, anchors of a group, columns read between two looks at the bounds.
BLOCK, GROUP, STEP = 2048, 512, 8
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Per cent of the positive's score that a negative has at least and at most.
LEAST, MOST = 50, 95
LARGEST = 1 << 28
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53


def usable() -> Column:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))


def integers(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q, n): rows that take part, with whole-numbered vectors and their length."""
    rows = embeddings.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("v"))
    limit = F.lit(float(LARGEST))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), limit), -limit).cast("int"))
    return rows.where(usable()).select("vec_id", "label", whole.alias("q"), F.size("v").alias("n"))


class Block:
    """Rows by ascending vec_id, a column per dimension, with the least and largest value of each column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(q[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.as_doubles: np.ndarray | None = None

    def doubles(self) -> np.ndarray:
        if self.as_doubles is None:
            self.as_doubles = self.columns.astype(np.float64)
        return self.as_doubles

    def scan(self, anchor: np.ndarray, bits: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates among ``bits`` that ``keep(low, high)`` lets stay to the end."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack((anchor * self.low, anchor * self.high))[:, order]
        least, most = ends.min(axis=0), ends.max(axis=0)
        rest_low = np.concatenate((np.cumsum(least[::-1])[::-1], [0]))
        rest_high = np.concatenate((np.cumsum(most[::-1])[::-1], [0]))
        exact = np.abs(ends).max(axis=0).sum(dtype=np.float64) < EXACT
        columns = self.doubles() if exact else self.columns
        weights = anchor.astype(columns.dtype)
        at = np.flatnonzero(bits)
        scores = np.zeros(len(at), columns.dtype)
        for start in range(0, len(order) + 1, STEP):
            # the bounds first, so a block that cannot matter is not read at all
            stays = keep(scores + rest_low[start], scores + rest_high[start])
            if not stays.all():
                at, scores = at[stays], scores[stays]
            dims = order[start : start + STEP]
            if not len(at) or not len(dims):
                break
            part = columns[dims] if len(at) == columns.shape[1] else columns[np.ix_(dims, at)]
            scores = scores + weights[dims] @ part
        return at, scores.astype(np.int64)


def among_best(count: int) -> Callable:
    """Rows that may be among the ``count`` best."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= count:
            return np.ones(len(low), bool)
        return high >= np.partition(low, -count)[-count]

    return keep


def in_windows(windows: list[tuple[int, int]], count: int) -> Callable:
    """Rows that may be among the ``count`` best inside one of the windows of scores."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for bottom, top in windows:
            sure = low[(low >= bottom) & (high <= top)]
            if len(sure) > count:
                bottom = max(bottom, np.partition(sure, -count)[-count])
            stays |= (low <= top) & (high >= bottom)
        return stays

    return keep


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def best(rows: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest scores; rows are sorted by vec_id, so a stable sort settles ties."""
    return np.argsort(-scores, kind="stable")[:count]


def whole_rows(column: pa.Scalar, n: int) -> tuple[np.ndarray, list, np.ndarray, pa.StructArray]:
    """(ids, labels, vectors, all fields) of a collected list of rows."""
    rows = column.values
    flat = rows.field("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.field("vec_id").to_numpy(zero_copy_only=False), rows.field("label").to_pylist(), flat.reshape(len(rows), n), rows


def numbered(own: list, others: list) -> tuple[np.ndarray, np.ndarray]:
    """Labels of two lists as small numbers that are equal where the labels are."""
    number = {label: i for i, label in enumerate(dict.fromkeys([*own, *others]))}
    return np.array([number[x] for x in own], np.int64), np.array([number[x] for x in others], np.int64)


def scanned(pairs: DataFrame, scan: Callable, names: list[str]) -> DataFrame:
    """``scan(anchors, own labels, block)`` over joined (anchors, rows, n), giving rows of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                ids, own, q, anchors = whole_rows(batch.column("anchors")[i], n)
                block_ids, others, block_q, _ = whole_rows(batch.column("rows")[i], n)
                own, others = numbered(own, others)
                block = Block(block_ids, others, block_q)
                out = [r for k in range(len(ids)) for r in scan(int(ids[k]), int(own[k]), q[k], anchors[k], block)]
                columns = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return pairs.select("n", "anchors", "rows").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def placed(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``home`` (a large label of its own, or small labels together) and ``part`` of the home."""
    counts = cut(rows.groupBy("n", "label").agg(F.count("*").alias("held")), "label-counts")
    few = counts.where(F.col("held") < block).agg(F.sum("held")).first()[0] or 0
    shelf = F.pmod(F.xxhash64("label"), F.lit(-(-few // block) or 1))
    large = F.col("held") >= block
    homes = counts.withColumn("home", F.when(large, F.xxhash64(F.lit("label"), "n", "label")).otherwise(F.xxhash64(F.lit("shelf"), "n", shelf)))
    sizes = homes.groupBy("home").agg(F.ceil(F.sum("held") / block).alias("parts"))
    named = homes.join(sizes, "home").select(F.col("n").alias("_n"), F.col("label").alias("_label"), "home", "parts")
    met = rows.join(named, (F.col("n") == F.col("_n")) & (F.col("label") == F.col("_label"))).drop("_n", "_label")
    return met.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).drop("parts")


def mine(
    embeddings: DataFrame,
    is_anchor: Column,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding).

    Anchors are the rows where ``is_anchor``, a condition on vec_id. Positives of an anchor are its best rows of the
    same label; a positive's negatives are the best rows of other labels with least % to most % of its score.
    """
    rows = cut(placed(integers(embeddings, scale), block), "whole-vectors")
    members = F.collect_set(F.struct("vec_id", "label", "q")).alias("rows")
    blocks = cut(rows.groupBy("n", "home", "part").agg(members), "vector-blocks")

    key = F.xxhash64("vec_id", "label", "q").alias("key")
    anchors = cut(rows.where(is_anchor).select("vec_id", "label", "q", "n", "home", key), "anchors")
    homes = anchors.groupBy("home").agg(F.ceil(F.count("*") / group).alias("parts"))
    grouped = anchors.join(homes, "home").withColumn("set", F.pmod("key", "parts"))
    grouped = grouped.groupBy("n", "home", "set").agg(F.collect_set(F.struct("key", "vec_id", "label", "q")).alias("anchors"))

    def find_positives(anchor: int, own: int, q: np.ndarray, row: pa.StructScalar, held: Block) -> Iterator[tuple]:
        at, scores = held.scan(q, (held.labels == own) & (held.ids != anchor), among_best(positives))
        for i in best(at, scores, positives):
            yield row["key"].as_py(), anchor, int(held.ids[at[i]]), int(scores[i])

    near = grouped.join(blocks.drop("n"), "home")
    found = scanned(near, find_positives, ["key", "anchor_id", "positive_id", "positive_score"])
    order = Window.partitionBy("key").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = cut(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")

    scores = chosen.groupBy("key").agg(F.collect_set("positive_score").alias("scores"))
    asked = anchors.dropDuplicates(["key"]).join(scores, "key")
    sets = asked.groupBy("n").agg(F.ceil(F.count("*") / group).alias("parts"))
    asked = asked.join(sets, "n").withColumn("set", F.pmod("key", "parts"))
    asked = cut(asked.groupBy("n", "set").agg(F.collect_list(F.struct("key", "vec_id", "label", "q", "scores")).alias("anchors")), "anchor-sets")

    def find_negatives(anchor: int, own: int, q: np.ndarray, row: pa.StructScalar, held: Block) -> Iterator[tuple]:
        windows = {s: window_of(s, least, most) for s in row["scores"].as_py()}
        windows = {s: w for s, w in windows.items() if w[0] <= w[1]}
        if not windows:
            return
        at, scores = held.scan(q, (held.labels != own) & (held.ids != anchor), in_windows(list(windows.values()), negatives))
        for score, (bottom, top) in windows.items():
            inside = np.flatnonzero((scores >= bottom) & (scores <= top))
            for i in inside[best(at[inside], scores[inside], negatives)]:
                yield row["key"].as_py(), score, int(held.ids[at[i]]), int(scores[i])

    spread = blocks.join(sets, "n").withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = spread.join(asked, ["n", "set"])
    others = scanned(met, find_negatives, ["key", "positive_score", "negative_id", "negative_score"])
    order = Window.partitionBy("key", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = cut(others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives")
    discard(rows, blocks, anchors, asked)
    return chosen.join(ranked, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
