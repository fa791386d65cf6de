"""Exact interpolated percentiles for groups of any size.

The built-in exact aggregate keeps every distinct value of a group in one
hash map. Here a mergeable sketch first narrows each wanted rank to a thin
value range; rows outside that range are only counted, and the ranks are then
read off the few values inside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tracks import spread

ACCURACY = 10_000
STEPS = 4096


def _nth(columns: list[Column]) -> Column:
    """The column numbered ``_i``, null past the last."""
    out = F.when(F.col("_i") == 0, columns[0])
    for i, c in enumerate(columns[1:], 1):
        out = out.when(F.col("_i") == i, c)
    return out


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: dict[str, float],
    block: Column,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> p).

    Linear interpolation between order statistics; nulls are ignored. Groups
    without values give no row. ``extra`` aggregates are computed in the
    sketch's pass over the non-null rows. ``block`` numbers bounded pieces of a group
    from 0, so that a large group is joined in many tasks.
    """
    names = sorted(probs, key=probs.get)
    reach = 2.0 / ACCURACY
    marks = [m for n in names for m in (max(0.0, probs[n] - reach), min(1.0, probs[n] + reach))]
    valued = df.withColumns({"_v": value.cast("double"), "block": block}).filter(F.col("_v").isNotNull())
    rows = valued.select(*keys, "_v", "block")
    per_group = valued.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        F.max("block").alias("last_block"),
        F.percentile_approx("_v", marks, ACCURACY).alias("_marks"),
        *extra,
    )
    if extra:
        per_group = cut_lineage(per_group, "sketch")
    sketch = per_group.select(*keys, "_total", "last_block", "_marks")
    lows = [F.col("_marks")[2 * i] for i in range(len(names))]
    highs = [F.col("_marks")[2 * i + 1] for i in range(len(names))]
    v = F.col("_v")
    # Number of ranges wholly below the value; if the next range holds the
    # value it is kept, else it only counts for the gap before that range.
    passed = reduce(lambda a, b: a + b, [(v > hi).cast("int") for hi in highs])
    low, high = _nth(lows), _nth(highs)
    inside = F.coalesce(v >= low, F.lit(False))
    step = F.coalesce(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * STEPS), F.lit(0))
    cells = (
        rows.join(spread(sketch), [*keys, "block"])
        .withColumn("_i", passed)
        .withColumn("_slab", F.col("_i") * (STEPS + 2) + F.when(inside, step + 1).otherwise(0))
        .groupBy(*keys, "_total", "_slab", F.when(inside, v).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    cells = cut_lineage(cells, "cells")
    # Cells are disjoint value ranges in slab order. Running counts go slab by
    # slab, then inside a slab, so no window holds all kept values of a group.
    start = Window.unboundedPreceding
    slabs = cells.groupBy(*keys, "_slab").agg(F.sum("_c").alias("_s")).select(
        *keys,
        "_slab",
        F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_slab").rowsBetween(start, -1)), F.lit(0)).alias("_base"),
    )
    order = Window.partitionBy(*keys, "_slab").orderBy("_min").rowsBetween(start, 0)
    ranked = (
        cells.withColumn("_run", F.sum("_c").over(order))
        .join(slabs, [*keys, "_slab"])
        .withColumn("_upto", F.col("_base") + F.col("_run"))
        .withColumn("_from", F.col("_upto") - F.col("_c") + 1)
    )

    def at(rank: Column) -> Column:
        pick = (
            F.when(F.col("_cell").isNotNull(), F.col("_cell"))
            .when(F.col("_upto") == rank, F.col("_max"))
            .when(F.col("_from") == rank, F.col("_min"))
            .otherwise(F.raise_error(F.lit("percentile rank outside its sketch range")).cast("double"))
        )
        return F.max(F.when((rank >= F.col("_from")) & (rank <= F.col("_upto")), pick))

    picks = []
    for n in names:
        first = F.floor(F.lit(float(probs[n])) * (F.col("_total") - 1)) + 1
        picks += [at(first).alias(f"_{n}_a"), at(F.least(first + 1, F.col("_total"))).alias(f"_{n}_b")]
    found = ranked.groupBy(*keys, "_total").agg(*picks)

    def between(n: str) -> Column:
        place = F.lit(float(probs[n])) * (F.col("_total") - 1)
        return F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * (place - F.floor(place))

    result = found.select(*keys, *[between(n).alias(n) for n in probs])
    return result.join(per_group.drop("_total", "last_block", "_marks"), list(keys)) if extra else result


# --- many columns at once -------------------------------------------------------
#
# A double as a signed whole number of 64 bits, its magnitude bits turned over where it is negative, sorts as the
# double does. The first ``TOP_BITS`` of that number (sign, exponent and the first digits) are its bin. One pass counts
# bins, one row per set, column and bin, with the least and largest value; of the bins that hold a wanted rank, those
# with more than one value are then read value by value.

TOP_BITS = 20
_LOW_BITS = 64 - TOP_BITS
_REST = (1 << 63) - 1
_HALF = 1 << (TOP_BITS - 1)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers that sort as the doubles do; both zeros are one, and what is no number comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & _REST)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    return (bits ^ ((bits >> 63) & _REST)).view(np.float64)


def _count_bins(columns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for c, name in enumerate(columns):
                column = batch.column(name)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                if not known.any():
                    continue
                values = ordered_bits(column.fill_null(0.0).to_numpy(zero_copy_only=False)[known])
                pairs = (codes[known].astype(np.int64) << TOP_BITS) + (values >> _LOW_BITS) + _HALF
                order = np.argsort(pairs)
                pairs, values = pairs[order], values[order]
                firsts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
                counts = np.diff(np.append(firsts, len(pairs)))
                owners, bins = pairs[firsts] >> TOP_BITS, (pairs[firsts] & ((1 << TOP_BITS) - 1)) - _HALF
                least, most = (from_ordered_bits(f.reduceat(values, firsts)) for f in (np.minimum, np.maximum))
                arrays = [keys.dictionary.take(pa.array(owners)), pa.array(np.full(len(counts), c, np.int32)), *map(pa.array, (bins, counts, least, most))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "c", "bin", "n", "least", "most"])

    return run


def wide_percentiles(df: DataFrame, key: str, columns: Sequence[str], probs: dict[str, float], block: Column | None = None) -> DataFrame:
    """(key, c, one column per entry of ``probs``) for the number c of each of ``columns``.

    As :func:`exact_percentiles` of each column, without a row per value: all columns of a row stay in
    it until only the few values in wanted bins are left. ``block`` numbers bounded pieces of a key from 0; without it, a large
    key is left to adaptive execution, which splits the rows' side of the join. Keys must not be null.
    """
    names = sorted(probs, key=probs.get)
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns], *([] if block is None else [block.alias("block")]))
    key_type = rows.schema["key"].dataType.simpleString()
    counted = rows.select("key", *columns).mapInArrow(_count_bins(columns), f"key {key_type}, c int, bin long, n long, least double, most double")
    bins = cut_lineage(counted.groupBy("key", "c", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")), "bins")

    whole = Window.partitionBy("key", "c")
    running = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(running)})
    ranks = []
    for i, name in enumerate(names):
        first = F.floor(F.lit(float(probs[name])) * (F.col("total") - 1)) + 1
        ranks += [F.struct(F.lit(2 * i).alias("j"), first.alias("rank")), F.struct(F.lit(2 * i + 1).alias("j"), F.least(first + 1, F.col("total")).alias("rank"))]
    inside = F.filter(F.array(*ranks), lambda r: (r["rank"] > F.col("upto") - F.col("n")) & (r["rank"] <= F.col("upto")))
    rest = (F.col("r.rank") - F.col("upto") + F.col("n")).alias("rest")
    wanted = placed.withColumn("r", F.explode(inside)).select("key", "c", "bin", "total", "r.j", rest, "least", "most")
    wanted = cut_lineage(wanted, "wanted_ranks")
    mixed = wanted.filter("least <> most")  # bins of several values; the others hold no question

    cells = F.struct("bin", "least", "most")
    of_column = [F.collect_set(F.when(F.col("c") == c, cells)).alias(f"_w{c}") for c in range(len(columns))]
    per_key = mixed.groupBy("key").agg(*of_column)
    if block is None:
        met = rows.join(per_key, "key")
    else:
        last = rows.groupBy("key").agg(F.max("block").alias("last_block"))
        met = rows.join(spread(per_key.join(last, "key")), ["key", "block"])

    def matches(c: int, name: str) -> Column:
        hit = F.filter(f"_w{c}", lambda w: (F.col(name) >= w["least"]) & (F.col(name) <= w["most"]))
        return F.transform(hit, lambda w: F.struct(F.lit(c).alias("c"), w["bin"].alias("bin"), (F.col(name) + 0.0).alias("v")))

    few = met.select("key", F.explode(F.flatten(F.array(*[matches(c, name) for c, name in enumerate(columns)]))).alias("m"))
    values = few.groupBy("key", "m.c", "m.bin", "m.v").agg(F.count(F.lit(1)).alias("n"))
    in_bin = Window.partitionBy("key", "c", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("upto", F.sum("n").over(in_bin))
    found = mixed.join(values, ["key", "c", "bin"]).filter((F.col("rest") > F.col("upto") - F.col("n")) & (F.col("rest") <= F.col("upto")))
    single = wanted.filter("least = most").select("key", "c", "total", "j", F.col("least").alias("v"))
    found = found.select("key", "c", "total", "j", "v").unionByName(single)
    picks = [F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"_{j}") for j in range(2 * len(names))]
    per_column = found.groupBy("key", "c", "total").agg(*picks)

    def between(i: int, name: str) -> Column:
        place = F.lit(float(probs[name])) * (F.col("total") - 1)
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return per_column.select(F.col("key").alias(key), "c", *[between(i, name) for i, name in enumerate(names)])
