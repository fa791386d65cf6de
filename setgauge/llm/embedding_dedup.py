"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors of a label are one class, counted and not compared. Class vectors go to the cell of
their nearest centre; a cell's rows of one label are cut into blocks by a hash, so a cell or label
with a third of all rows is many blocks. Two blocks of a label are compared, by one matrix product,
unless their centres are too far apart for any pair: two vectors within the angle e of each other
lie in cells whose centres are at most (radius + radius + e) apart. So cells only leave out pairs
that cannot link, and no link is lost. Of a product only the number of links of each vector and
one link to the smallest vector of its local group leave the task, never all pairs.

The centres are fitted on ``SAMPLE`` vectors at most, chosen by a hash of their id.

Cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label or
vec_id, link with nothing and are kept. Vectors of different lengths do not link. Rows with the same vec_id
and vector count as one more linked copy; ties go to the smallest vec_id. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setgauge.llm.common import components, cut, discard

LEAST_COSINE = 0.93
#: Vectors of a block, vectors that centres are fitted on, rounds of fitting, most cells.
BLOCK, SAMPLE, ROUNDS, MOST_CELLS, SEED = 1024, 16_384, 4, 1024, 3


def unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable():
    """Whether a row (vec_id, label, v) can link at all."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return F.coalesce(known & finite & F.exists("v", lambda x: x != 0), F.lit(False))


def by_length(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of a batch, for each length of vector."""
    lengths = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, unit(matrix(batch.column(column).take(pa.array(at))))


def centres(classes: DataFrame, cells: int, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Centres for each length of vector, by spherical k-means over a bounded sample."""
    sample = cut(classes.orderBy(F.xxhash64(F.lit(SEED), "first"), "first").limit(SAMPLE).select("first", "v"), "kmeans-sample")
    starts = sample.withColumn("n", F.size("v")).orderBy(F.xxhash64(F.lit(SEED + 1), "first")).limit(cells).collect()
    found: dict[int, np.ndarray] = {}
    for n in {r["n"] for r in starts} | {r["n"] for r in sample.select(F.size("v").alias("n")).distinct().collect()}:
        own = [r["v"] for r in starts if r["n"] == n]
        found[n] = unit(np.array(own, np.float64)) if own else unit(np.ones((1, n)))
    for _ in range(rounds if cells > 1 else 0):
        now = found

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = {n: np.zeros_like(c) for n, c in now.items()}
            for batch in batches:
                for _, x in by_length(batch):
                    c = now[x.shape[1]]
                    np.add.at(total[x.shape[1]], (x @ c.T).argmax(axis=1), x)
            for n, t in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(t), pa.int32()), pa.array(range(len(t)), pa.int32()), pa.array(t.tolist(), pa.list_(pa.float64()))], names=["n", "cell", "total"]
                )

        parts = sample.select("v").coalesce(8).mapInArrow(sums, "n int, cell int, total array<double>").collect()  # 8 * cells rows at most
        moved = {n: np.zeros_like(c) for n, c in now.items()}
        for n, cell, total in parts:
            moved[n][cell] += np.array(total)
        found = {n: np.where(np.abs(moved[n]).max(axis=1, keepdims=True) > 0, unit_or_zero(moved[n]), c) for n, c in now.items()}
    discard(sample)
    return found


def unit_or_zero(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def in_cells(classes: DataFrame, found: dict[int, np.ndarray]) -> DataFrame:
    """Adds the nearest cell and the angle to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.pi)
            for at, x in by_length(batch):
                if x.shape[1] in found:  # else a length that the sample lacks: one cell as wide as can be
                    near = x @ found[x.shape[1]].T
                    cell[at] = near.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", cell int, angle double"
    return classes.mapInArrow(run, schema)


def block_pairs(sizes: DataFrame, found: dict[int, np.ndarray], least: float) -> DataFrame:
    """Pairs of blocks that may hold a link, from one row per (label, length, cell, blocks, radius)."""
    reach = float(np.arccos(min(1.0, least))) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: [] for n in ("label", "length", "cell", "other", "apart")}
            for label, n, cell in zip(*(batch.column(c).to_pylist() for c in ("label", "length", "cell"))):
                c = found.get(n)
                apart = [0.0] if c is None else np.arccos(np.clip(c @ c[cell], -1, 1)).tolist()
                for other, angle in enumerate(apart):
                    if other >= cell:
                        for key, value in zip(rows, (label, n, cell, other, angle if other != cell else 0.0)):
                            rows[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=batch.schema.field("label").type if k == "label" else pa.float64() if k == "apart" else pa.int32()) for k, v in rows.items()], names=list(rows)
            )

    label_type = sizes.schema["label"].dataType.simpleString()
    cells = sizes.select("label", "length", "cell").mapInArrow(near, f"label {label_type}, length int, cell int, other int, apart double")
    a = sizes.select("label", "length", "cell", F.col("blocks").alias("blocks_a"), F.col("radius").alias("radius_a"))
    b = sizes.select("label", "length", F.col("cell").alias("other"), F.col("blocks").alias("blocks_b"), F.col("radius").alias("radius_b"))
    met = cells.join(a, ["label", "length", "cell"]).join(b, ["label", "length", "other"]).where(F.col("apart") <= F.col("radius_a") + F.col("radius_b") + reach)
    pairs = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    return pairs.where("cell < other OR block <= other_block").select("label", "length", "cell", "block", "other", "other_block")


def compare(a_ids, a_sizes, a, b_ids, b_sizes, b, same: bool, least: float) -> list[tuple[int, int, int]]:
    """(vector, smallest vector of its group here, links) of the vectors that link in one product."""
    linked = unit(a) @ unit(b).T >= least
    if same:
        np.fill_diagonal(linked, False)
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked = linked[np.ix_(rows, columns)]
    low_a, low_b = a_ids[rows].copy(), b_ids[columns].copy()
    if not len(rows):
        return []
    top = np.iinfo(np.int64).max
    while True:  # smallest id along links, until nothing changes
        new_a = np.minimum(low_a, np.where(linked, low_b[None, :], top).min(axis=1))
        new_b = np.minimum(low_b, np.where(linked, new_a[:, None], top).min(axis=0))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    out = list(zip(a_ids[rows].tolist(), low_a.tolist(), (linked @ b_sizes[columns]).tolist()))
    if not same:
        out += zip(b_ids[columns].tolist(), low_b.tolist(), (a_sizes[rows] @ linked).tolist())
    return out


def compared(pairs: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(first, root, links) rows of all products."""
    keys = ("label", "length", "cell", "block")
    a = blocks.select(*keys, F.col("rows").alias("rows_a"))
    b = blocks.select("label", "length", F.col("cell").alias("other"), F.col("block").alias("other_block"), F.col("rows").alias("rows_b"))
    both = pairs.join(a, list(keys)).join(b, ["label", "length", "other", "other_block"])
    same = (F.col("cell") == F.col("other")) & (F.col("block") == F.col("other_block"))

    def parts(scalar):
        rows = scalar.values if hasattr(scalar, "values") else scalar
        return rows.field("first").to_numpy(), rows.field("n").to_numpy(), matrix(rows.field("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = compare(*parts(batch.column("rows_a")[i]), *parts(batch.column("rows_b")[i]), batch.column("same")[i].as_py(), least)
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["first", "root", "links"])

    few = both.select("rows_a", "rows_b", same.alias("same"))
    return few.mapInArrow(run, "first long, root long, links long")


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    number = "float" if element == "float" else "double"
    rows = embeddings.select(
        F.col("vec_id").cast("long"), "label", F.transform(F.col("embedding").cast(f"array<{number}>"), lambda x: x + F.lit(0).cast(number)).alias("v")
    )
    good = rows.where(usable()).withColumn("hash", F.xxhash64("v"))
    classes = cut(good.groupBy("label", "hash", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")), "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cells = max(1, min(MOST_CELLS, -(-largest // block)))
    found = centres(classes, cells)
    placed = cut(in_cells(classes.withColumn("length", F.size("v")).drop("hash"), found), "cells")
    sizes = placed.groupBy("label", "length", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("angle").alias("radius"))
    sizes = cut(sizes, "cell-sizes")
    number_of = sizes.select("label", "length", "cell", "blocks")
    spread = placed.join(number_of, ["label", "length", "cell"]).withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
    blocks = cut(spread.groupBy("label", "length", "cell", "block").agg(F.collect_list(F.struct("first", "n", "v")).alias("rows")), "blocks")
    results = cut(compared(block_pairs(sizes, found, least), blocks, least), "products")
    linked = results.groupBy("first").agg(F.sum("links").alias("links"))
    roots = components(results.select(F.col("first").alias("a"), F.col("root").alias("b")), "vector-roots").withColumnRenamed("node", "first")
    discard(placed, sizes, blocks)
    named = classes.join(linked, "first", "left").join(roots, "first", "left").select(
        F.col("label").alias("_label"), F.col("hash").alias("_hash"), F.col("v").alias("_v"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("root", "first").alias("_root"),
    )
    members = good.join(named, (F.col("hash") == F.col("_hash")) & (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")))
    alone = rows.where(~usable())
    out = members.select("vec_id", F.col("_links").alias("n_links"), F.col("_root").alias("component_id")).union(
        alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def kept(embeddings: DataFrame, **settings) -> DataFrame:
    """The rows of ``embeddings`` with one vector of each group."""
    gone = near_duplicates(embeddings, **settings).where("NOT kept").select(F.col("vec_id").alias("_gone")).distinct()
    return embeddings.join(gone, embeddings["vec_id"] == gone["_gone"], "left_anti")
