"""Ordered operators over frame tracks, cut into bounded blocks.

A track is the ordered frames of one set. A plain window partitioned by the
set puts a whole set into one task, which fails when one set holds a large
share of all rows. Here every ordered operator works on blocks of a track:

* bounded windows run inside a block that also holds copies of the few
  neighbouring rows they look at (``with_halo``),
* unbounded looks (nearest valid value, previous row) combine an in-block
  window with one carried row per block (``bracket``, ``neighbours``),
* per-set statistics are copied once per block and joined on
  ``(set, block)`` (``spread``), so a long set is joined in many tasks.

Only one row per block ever meets its set in a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
SET = ("set_id",)
#: Rows that one task of :func:`dealt` holds on average.
ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its number of ``rows`` asks for; unknown or few: as it is.

    Adaptive execution joins partitions by their compressed bytes, of which many rows may have few.
    """
    parts = -(-(rows or 0) // ROWS_PER_TASK)
    return df.repartition(parts, *keys) if parts > 1 else df


def block_of(pos: Column | str, size: int | None = None) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size or BLOCK)).cast("long")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    slab: Column,
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Dense 0-based position per key, without sorting a key in one task.

    ``slab`` must not decrease along ``order``. Rows are numbered inside
    ``(key, slab)`` and shifted by the row counts of earlier slabs.
    """
    cut = df.withColumn("_slab", slab)
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_slab").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(
        *keys,
        "_slab",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        *([F.sum("_n").over(per_key).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "_slab").orderBy(*order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(base, [*keys, "_slab"])
        .withColumn(out, F.col("_base") + F.col("_rn") - 1)
        .drop("_slab", "_rn", "_base")
    )


def frame_positions(df: DataFrame, keys: Sequence[str] = SET, order: str = "frame_index") -> DataFrame:
    """Position of each frame in its (possibly sampled) track."""
    return number_rows(df, keys, [order], block_of(order))


def with_halo(df: DataFrame, left: int, right: int, size: int | None = None, pos: str = "pos") -> DataFrame:
    """Assign rows to blocks, copying rows near an edge to the neighbour block.

    Adds ``block`` and ``home``; keep ``home`` rows after the windows ran.
    """
    size = size or BLOCK
    if max(left, right) > size:
        raise ValueError("halo wider than a block")
    own = block_of(pos, size)
    offset = F.col(pos) % size
    targets = F.array_compact(
        F.array(
            own,
            F.when(offset >= size - left, own + 1),
            F.when((offset < right) & (own > 0), own - 1),
        )
    )
    return df.withColumn("block", F.explode(targets)).withColumn("home", F.col("block") == own)


def block_window(keys: Sequence[str] = SET, pos: str = "pos"):
    return Window.partitionBy(*keys, "block").orderBy(pos)


def _edges(blocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block: last marked row of earlier blocks, first of later ones."""
    up = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    marks = blocked.groupBy(*keys, "block").agg(
        F.min("_here").alias("_lo"), F.max("_here").alias("_hi"), F.count("_here").alias("_n")
    )
    return marks.select(
        *keys,
        "block",
        F.last("_hi", ignorenulls=True).over(up).alias("_before"),
        F.last("_lo", ignorenulls=True).over(down).alias("_after"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n_valid"),
    )


def bracket(
    df: DataFrame,
    values: Sequence[str],
    valid: Column,
    keys: Sequence[str] = SET,
    pos: str = "pos",
    strict_next: bool = False,
    strict_prev: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Nearest valid rows around every row of a track.

    Adds ``prev`` (at or before) and ``next`` (at or after) as structs of
    ``pos`` and ``values``, and ``n_valid`` of the whole track. ``strict_*``
    leave the row itself out. ``rows`` as in :func:`dealt`.
    """
    blocked = dealt(df.withColumn("block", block_of(pos)), [*keys, "block"], rows).withColumn(
        "_here", F.when(valid, F.struct(F.col(pos).alias("pos"), *values))
    )
    start = Window.unboundedPreceding
    up = block_window(keys, pos).rowsBetween(start, -1 if strict_prev else 0)
    down = Window.partitionBy(*keys, "block").orderBy(F.desc(pos)).rowsBetween(start, -1 if strict_next else 0)
    return (
        blocked.withColumn("_p", F.last("_here", ignorenulls=True).over(up))
        .withColumn("_q", F.last("_here", ignorenulls=True).over(down))
        .join(_edges(blocked, keys), [*keys, "block"])
        .withColumn("prev", F.coalesce("_p", "_before"))
        .withColumn("next", F.coalesce("_q", "_after"))
        .drop("_p", "_q", "_here", "_before", "_after", "block")
    )


def neighbours(df: DataFrame, values: Sequence[str], keys: Sequence[str] = SET, pos: str = "pos") -> DataFrame:
    """Previous and next row of the track as structs ``prev`` and ``next``."""
    blocked = df.withColumn("block", block_of(pos)).withColumn(
        "_here", F.struct(F.col(pos).alias("pos"), *values)
    )
    order = block_window(keys, pos)
    return (
        blocked.withColumn("_p", F.lag("_here").over(order))
        .withColumn("_q", F.lead("_here").over(order))
        .join(_edges(blocked, keys), [*keys, "block"])
        .withColumn("prev", F.coalesce("_p", "_before"))
        .withColumn("next", F.coalesce("_q", "_after"))
        .drop("_p", "_q", "_here", "_before", "_after", "n_valid", "block")
    )


def spread(stats: DataFrame, last_block: str = "last_block") -> DataFrame:
    """One copy of a per-set row for each block of its track."""
    return stats.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(last_block)))).drop(last_block)


def with_set_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str] = SET, pos: str = "pos") -> DataFrame:
    """Join per-set ``stats`` (carrying ``last_block``) to the rows of a track."""
    return (
        df.withColumn("block", block_of(pos)).join(spread(stats), [*keys, "block"]).drop("block")
    )


def last_block(pos: str = "pos") -> Column:
    return F.max(block_of(pos)).alias("last_block")
