"""Gap filling, smoothing and local extrema of one signal per set.

Column functions take a block window (``tracks.block_window``) over rows that
already carry a halo wide enough for the function; the DataFrame functions
arrange the blocks themselves. Input positions are dense (``pos``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..session import cut_lineage
from . import tracks
from .tracks import SET, block_of, block_window, bracket, with_halo

SMALL_BLOCK = 1024


# --- gap filling ---------------------------------------------------------


def _between(prev: str, nxt: str, field: str, pos: str) -> Column:
    """Value on the line through two neighbouring samples."""
    p, q = F.col(prev), F.col(nxt)
    share = (F.col(pos) - p["pos"]) / (q["pos"] - p["pos"])
    return (
        F.when(p.isNull() & q.isNull(), F.lit(None).cast("double"))
        .when(p.isNull(), q[field])
        .when(q.isNull() | (q["pos"] == p["pos"]), p[field])
        .otherwise(p[field] + (q[field] - p[field]) * share)
    )


def fill_gaps(
    df: DataFrame,
    value: str,
    out: str | None = None,
    keys: Sequence[str] = SET,
    pos: str = "pos",
    all_missing: float | None = 0.0,
    min_valid: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """Linear fill between valid samples, constant at both ends.

    A set without any valid sample gets ``all_missing``; a set with fewer than
    ``min_valid`` valid samples keeps its values untouched. ``rows`` as in ``tracks.dealt``.
    """
    marked = bracket(df, [value], F.col(value).isNotNull(), keys, pos, rows=rows)
    line = _between("prev", "next", value, pos)
    if all_missing is not None:
        line = F.coalesce(line, F.lit(float(all_missing)))
    if min_valid:
        line = F.when(F.col("n_valid") < min_valid, F.col(value)).otherwise(line)
    return marked.withColumn(out or value, line).drop("prev", "next", "n_valid")


# --- column functions over a block window --------------------------------


def box_mean(value: Column, taps: int, window) -> Column:
    """Sum of the centred taps over the tap count; missing taps count as 0."""
    half = taps // 2
    return F.sum(value).over(window.rowsBetween(-half, taps - 1 - half)) / taps


def centred_median(value: Column, taps: int, window, pos: str = "pos") -> Column:
    """Centred median; the first and last sample repeat beyond the ends."""
    if taps < 3:
        return value
    taps += 1 - taps % 2
    pad = taps // 2
    seen = F.collect_list(value).over(window.rowsBetween(-pad, pad))
    left = F.greatest(F.lit(pad) - F.col(pos), F.lit(0)).cast("int")
    right = F.greatest(F.lit(taps) - F.size(seen) - left, F.lit(0)).cast("int")
    padded = F.concat(
        F.array_repeat(F.element_at(seen, 1), left), seen, F.array_repeat(F.element_at(seen, -1), right)
    )
    return F.element_at(F.array_sort(padded), pad + 1)


def ema_reach(alpha: float) -> int:
    """Rows after which an older sample weighs less than 2**-60."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    return math.ceil(-60 * math.log(2) / math.log1p(-alpha)) if alpha < 1 else 0


def ema_block(alpha: float, extra: int = 0) -> int:
    """Block size that holds the reach of ``alpha`` and ``extra`` more rows as a halo."""
    return max(SMALL_BLOCK, ema_reach(alpha) + extra)


def ema(df: DataFrame, value: str, alpha: float, out: str, keys: Sequence[str] = SET, grid_bits: int | None = 30) -> DataFrame:
    """Exponential moving average inside haloed blocks of ``ema_block`` rows, for 0 < alpha <= 1.

    The fold ``y = a*x + (1-a)*y`` is the running sum of samples scaled by growing powers, scaled back
    at the row. Powers grow inside stretches so short that they stay below 2**600; a stretch takes over
    the last value of the one before, and what came earlier weighs less than 2**-600. The fold starts at
    the first row of the block: the set's first sample, or a halo row at least ``ema_reach`` before the
    first home row, whose weight is then below double precision.
    Results sit on a grid of 2**-grid_bits, so that two orders of evaluation agree on them; None leaves
    them as they are, and values too large for the grid stay as they are in any case.
    """
    if alpha == 1:
        return df.withColumn(out, F.col(value).cast("double"))
    keep = 1.0 - alpha
    stretch = max(1, int(600 * math.log(2) / -math.log1p(-alpha)))
    step = F.row_number().over(block_window(keys)) - 1
    numbered = df.withColumn("_j", step).withColumn("_part", F.floor(F.col("_j") / stretch)).withColumn("_i", (F.col("_j") % stretch).cast("double"))
    weighed = F.when(F.col("_j") == 0, F.col(value)).otherwise(F.lit(alpha) * F.col(value)) * F.pow(F.lit(keep), -F.col("_i"))
    inside = Window.partitionBy(*keys, "block", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = numbered.withColumn("_w", weighed).withColumn("_z", F.sum("_w").over(inside) * F.pow(F.lit(keep), F.col("_i")))
    ended = F.last(F.when(F.col("_i") == stretch - 1, F.col("_z")), ignorenulls=True)
    before = ended.over(block_window(keys).rowsBetween(Window.unboundedPreceding, -1))
    mixed = F.col("_z") + F.coalesce(F.pow(F.lit(keep), F.col("_i") + 1) * before, F.lit(0.0))
    return summed.withColumn(out, mixed if grid_bits is None else snap(mixed, grid_bits)).drop("_j", "_part", "_i", "_w", "_z")


def rise_over_valley(value: Column, half: int, window) -> Column:
    """Height of a strict-left local maximum over the lowest nearby sample.

    Null where the row is no local maximum (first and last samples never are).
    """
    is_top = (value > F.lag(value).over(window)) & (value >= F.lead(value).over(window))
    return F.when(is_top, value - F.min(value).over(window.rowsBetween(-half, half)))


# --- DataFrame forms ------------------------------------------------------


def moving_average(df: DataFrame, value: str, out: str, taps: int = 7, keys: Sequence[str] = SET) -> DataFrame:
    """Fill gaps, then a zero-padded box; under two valid samples: unchanged."""
    marked = bracket(df, [value], F.col(value).isNotNull(), keys)
    line = F.coalesce(_between("prev", "next", value, "pos"), F.col(value))
    halo = with_halo(marked.withColumn("_line", line).drop("prev", "next"), taps // 2, taps // 2)
    smooth = box_mean(F.col("_line"), taps, block_window(keys))
    return (
        halo.withColumn(out, F.when(F.col("n_valid") < 2, F.col(value)).otherwise(smooth))
        .filter("home")
        .drop("_line", "n_valid", "block", "home")
    )


def median_filter(df: DataFrame, value: str, out: str, taps: int = 5, keys: Sequence[str] = SET) -> DataFrame:
    halo = with_halo(df, taps, taps)
    return (
        halo.withColumn(out, centred_median(F.col(value), taps, block_window(keys)))
        .filter("home")
        .drop("block", "home")
    )


def smooth_signal(
    df: DataFrame,
    value: str,
    out: str,
    alpha: float = 0.35,
    taps: int = 5,
    keys: Sequence[str] = SET,
    extra: int = 0,
    home_only: bool = True,
    grid_bits: int | None = 30,
) -> DataFrame:
    """Fill, centred median, exponential average: the rep-signal chain.

    All windows share one shuffle. ``extra`` widens the halo on both sides for
    windows the caller adds before filtering on ``home``.
    """
    filled = fill_gaps(df, value, out, keys)
    halo = with_halo(filled, ema_reach(alpha) + taps + extra, taps + extra, ema_block(alpha, taps + extra))
    medians = halo.withColumn("_m", centred_median(F.col(out), taps, block_window(keys)))
    smooth = ema(medians, "_m", alpha, out, keys, grid_bits).drop("_m")
    return smooth.filter("home").drop("block", "home") if home_only else smooth


def ema_signal(
    df: DataFrame, value: str, out: str, alpha: float = 0.35, keys: Sequence[str] = SET, grid_bits: int | None = 30, rows: int | None = None
) -> DataFrame:
    halo = tracks.dealt(with_halo(df, ema_reach(alpha), 0, ema_block(alpha)), [*keys, "block"], rows)
    return ema(halo, value, alpha, out, keys, grid_bits).filter("home").drop("block", "home")


def local_tops(
    df: DataFrame, value: str, min_dist: int, share: float, keys: Sequence[str] = SET, sign: int = 1
) -> DataFrame:
    """Local maxima (``sign=-1``: minima) rising over their valley by
    ``share`` of the signal's range. Columns: keys, pos, height, rise, floor."""
    half = max(3, min_dist // 2)
    z = df.withColumn("height", F.col(value) * sign)
    halo = with_halo(z.select(*keys, "pos", "height"), half + 1, half + 1)
    tops = (
        halo.withColumn("rise", rise_over_valley(F.col("height"), half, block_window(keys)))
        .filter("home AND rise IS NOT NULL")
        .drop("block", "home")
    )
    span = z.groupBy(*keys).agg(
        ((F.max("height") - F.min("height")) * share).alias("floor"), tracks.last_block()
    )
    return tracks.with_set_stats(tops, span, keys).filter("rise >= floor")


def joint_speed(df: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """First and second differences of x and y along a joint's track."""
    halo = with_halo(df, 2, 0, pos=order)
    w = block_window(keys, order)
    moved = halo.withColumn("vx", F.col("x") - F.lag("x").over(w)).withColumn("vy", F.col("y") - F.lag("y").over(w))
    return (
        moved.withColumn("ax", F.col("vx") - F.lag("vx").over(w))
        .withColumn("ay", F.col("vy") - F.lag("vy").over(w))
        .filter("home")
        .drop("block", "home")
    )


def hold_last(df: DataFrame, value: str, out: str, limit: int = 12, keys: Sequence[str] = SET) -> DataFrame:
    """Repeat the last valid value for at most ``limit`` missing rows."""
    halo = with_halo(df, limit, 0)
    held = F.last(value, ignorenulls=True).over(block_window(keys).rowsBetween(-limit, 0))
    return halo.withColumn(out, held).filter("home").drop("block", "home")


def smooth_boxes(df: DataFrame, corners: Sequence[str], taps: int = 15, keys: Sequence[str] = SET) -> DataFrame:
    """Moving average of box corners with the edge value repeated, truncated
    to whole pixels. Missing corners weigh in as 0 and stay missing."""
    half = taps // 2
    numbered = df
    for c in corners:
        numbered = numbered.withColumn(f"_{c}", F.coalesce(F.col(c), F.lit(0)).cast("double"))
    halo = with_halo(numbered, half, half)
    w = block_window(keys).rowsBetween(-half, half)
    for c in corners:
        seen = F.collect_list(f"_{c}").over(w)
        left = F.greatest(F.lit(half) - F.col("pos"), F.lit(0)).cast("int")
        right = F.lit(taps) - F.size(seen) - left
        total = (
            F.sum(f"_{c}").over(w) + F.element_at(seen, 1) * left + F.element_at(seen, -1) * right
        )
        halo = halo.withColumn(f"{c}_smooth", F.when(F.col(c).isNotNull(), (total / taps).cast("int")))
    return halo.filter("home").drop("block", "home", *[f"_{c}" for c in corners])


def fill_boxes(df: DataFrame, corners: Sequence[str], keys: Sequence[str] = SET) -> DataFrame:
    """A missing box takes the previous one, else the next valid one."""
    marked = bracket(df, list(corners), F.col(corners[0]).isNotNull(), keys)
    for c in corners:
        marked = marked.withColumn(c, F.coalesce(F.col(f"prev.{c}"), F.col(f"next.{c}")))
    return marked.drop("prev", "next", "n_valid")


def stride_frames(df: DataFrame, fps: Column, target: Column, order: str = "frame_index") -> DataFrame:
    """Keep every Nth frame, N = fps / target rounded half to even, at least 1."""
    step = F.greatest(F.lit(1), F.bround(fps / target).cast("int"))
    return df.filter(F.col(order) % step == 0)


def trim_range(df: DataFrame, trims: DataFrame, key: str = "set_id") -> DataFrame:
    """Frames inside a set's [start_s, end_s]; sets without a usable range stay whole."""
    at = F.col("frame_index") / F.col("fps")
    usable = F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("end_s") > F.col("start_s"))
    joined = df.withColumn("block", block_of("frame_index"))
    spans = df.groupBy(key).agg(F.max(block_of("frame_index")).alias("last_block"))
    wanted = tracks.spread(spans.join(trims, key))
    return (
        joined.join(wanted, [key, "block"], "left")
        .filter(~F.coalesce(usable, F.lit(False)) | at.between(F.col("start_s"), F.col("end_s")))
        .drop("block", "start_s", "end_s")
    )


def observed_downsample(df: DataFrame, target_fps: float, keys: Sequence[str] = SET, order: str = "frame") -> DataFrame:
    """Thin each set to about ``target_fps`` by its observed frame rate.

    The rate is one over the median time step (30 for a single row); every
    int(rate / target)-th row stays when the rate exceeds the target.
    """
    from .quantiles import exact_percentiles

    placed = cut_lineage(tracks.frame_positions(df, keys, order), "placed")  # numbered once for the steps, their median and the rows
    halo = with_halo(placed.select(*keys, "pos", "timestamp"), 1, 0)
    steps = cut_lineage(
        halo.withColumn("_dt", F.col("timestamp") - F.lag("timestamp").over(block_window(keys)))
        .filter("home AND _dt IS NOT NULL")
        .select(*keys, "pos", "_dt"),
        "steps",
    )
    median = exact_percentiles(steps, keys, F.col("_dt"), {"_step": 0.5}, block_of("pos"))
    spans = placed.groupBy(*keys).agg(tracks.last_block())
    rate = F.coalesce(F.lit(1.0) / F.nullif(F.col("_step"), F.lit(0.0)), F.lit(30.0))
    every = F.when(rate > target_fps, (rate / target_fps).cast("int")).otherwise(F.lit(1))
    stats = spans.join(median, list(keys), "left").withColumn("_every", every).drop("_step")
    return tracks.with_set_stats(placed, stats, keys).filter("pos % _every = 0").drop("_every")


def interpolate_track(
    samples: DataFrame, values: Sequence[str], keys: Sequence[str], last_frame: str, order: str = "frame_index"
) -> DataFrame:
    """Values at every frame 0..``last_frame`` between sampled frames.

    Sampled frames bracket each frame even where their values are missing; a
    missing end makes the blend missing. After the last sample its value
    stays. ``last_frame`` is a per-set column of ``samples``.
    """
    sizes = samples.groupBy(*keys).agg(F.max(last_frame).alias("_last"))
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block_of("_last"))))
    spine = (
        blocks.repartition(*keys, "block")
        .withColumn(
            order,
            F.explode(
                F.sequence(
                    F.col("block") * tracks.BLOCK, F.least(F.col("_last"), (F.col("block") + 1) * tracks.BLOCK - 1)
                )
            ),
        )
        .drop("_last")
    )
    here = samples.select(
        *keys, F.col(order).cast("long").alias(order), block_of(order).alias("block"), *values, F.lit(True).alias("_hit")
    )
    joined = spine.join(here, [*keys, "block", order], "left").drop("block")
    placed = bracket(joined, list(values), F.col("_hit"), keys, order, strict_prev=True)
    p, q = F.col("prev"), F.col("next")
    share = (F.col(order) - p["pos"]) / (q["pos"] - p["pos"])
    out = placed
    for v in values:
        out = out.withColumn(
            f"_{v}",
            F.when(p.isNull(), q[v]).when(q.isNull(), p[v]).otherwise(p[v] * (1 - share) + q[v] * share),
        )
    return out.select(*keys, order, *[F.col(f"_{v}").alias(v) for v in values])
