"""Peak selection: distance thinning, full peak finding, prominence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tracks
from .tracks import SET, block_of, block_window, neighbours, with_halo


def thin_by_distance(
    tops: DataFrame, min_dist: int, keys: Sequence[str] = SET, later_first: bool = False, rounds: list[int] | None = None
) -> DataFrame:
    """Keep tops highest first, dropping any closer than ``min_dist`` to a kept one.

    Equal heights: the earlier (or, with ``later_first``, the later) row wins.
    A top that is the best within reach is kept for certain, and the others
    within its reach are dropped for certain; two such rounds run inside
    blocks. The few rows still open are chosen by :func:`fold_by_blocks`, whose
    number of rounds is appended to ``rounds``.
    """
    if min_dist <= 1:
        return tops
    tie = F.col("pos") if later_first else -F.col("pos")
    ranked = tops.withColumn("_rank", F.struct(F.col("height").alias("h"), tie.alias("t")))
    size = max(tracks.BLOCK, 8 * min_dist)
    halo = with_halo(ranked, 4 * min_dist, 4 * min_dist, size)
    near = block_window(keys).rangeBetween(-(min_dist - 1), min_dist - 1)
    state = halo.withColumn("_kept", F.lit(False)).withColumn("_open", F.lit(True))
    for _ in range(2):
        state = state.withColumn("_best", F.max(F.when(F.col("_open"), F.col("_rank"))).over(near))
        state = state.withColumn("_now", F.col("_open") & (F.col("_best") == F.col("_rank")))
        state = state.withColumn("_hit", F.max(F.col("_now")).over(near))
        state = state.withColumn("_kept", F.col("_kept") | F.col("_now")).withColumn(
            "_open", F.col("_open") & ~F.col("_hit")
        )
    settled = cut_lineage(
        state.filter("home AND (_kept OR _open)").drop("block", "home", "_best", "_now", "_hit", "_rank"), "tops"
    )
    sure = settled.filter("_kept").drop("_kept", "_open")
    rest = settled.filter("_open").drop("_kept", "_open")
    if rest.isEmpty():
        return sure
    chosen, n = fold_by_blocks(rest, min_dist, later_first, keys)
    if rounds is not None:
        rounds.append(n)
    return sure.unionByName(chosen.select(*sure.columns))


def _ranked(row: Column, later_first: bool) -> Column:
    at = -row["pos"] if later_first else row["pos"]
    return F.struct((-row["height"]).alias("h"), at.alias("t"))


def _best_first(
    tops: DataFrame, group: Sequence[str], min_dist: int, later_first: bool, keys: Sequence[str], rivals: DataFrame | None = None
) -> DataFrame:
    """Greedy choice inside each group; ``rivals`` are tops kept elsewhere that
    beat lower ones within reach. Groups hold a bounded number of rows."""
    columns = [c for c in tops.columns if c not in keys]
    row = F.struct(*columns)
    grouped = tops.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(_ranked(row, later_first).alias("rank"), row.alias("row")))).alias("_ordered")
    )
    none = F.slice(F.transform("_ordered", lambda c: F.struct(c["row"]["pos"].alias("pos"), c["rank"].alias("rank"))), 1, 0)
    if rivals is not None:
        grouped = grouped.join(rivals, list(group), "left").withColumn("_rivals", F.coalesce("_rivals", none))
    else:
        grouped = grouped.withColumn("_rivals", none)

    def clear(taken, c):
        return F.forall(taken, lambda k: (F.abs(k["pos"] - c["row"]["pos"]) >= min_dist) | (k["rank"] > c["rank"]))

    def next_kept(kept, c):
        free = clear(F.transform(kept, lambda k: F.struct(k["row"]["pos"].alias("pos"), k["rank"].alias("rank"))), c)
        return F.when(free & clear(F.col("_rivals"), c), F.concat(kept, F.array(c))).otherwise(kept)

    chosen = F.aggregate("_ordered", F.slice("_ordered", 1, 0), next_kept)
    return grouped.withColumn("_chosen", F.transform(chosen, lambda c: c["row"])).select(
        *[k for k in keys], F.inline("_chosen")
    )


def fold_by_blocks(tops: DataFrame, min_dist: int, later_first: bool, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Greedy choice of tops, block by block until nothing changes, and the number of rounds.

    Each block chooses against the tops its neighbours kept last time. A choice
    in which every block agrees with its neighbours is the greedy choice: a top
    is kept exactly if no better kept one is within reach. What a top decides depends on better tops
    alone, so a round settles every block whose better neighbours are settled: the rounds are those of the longest
    run of blocks in which each waits for the next, plus two; of tops without such a slope, two or three.
    """
    size = 32 * min_dist
    blocked = tops.withColumn("block", block_of("pos", size))
    group = [*keys, "block"]
    kept, n = None, 0
    while True:
        rivals = None
        if kept is not None:
            near_edge = with_halo(kept.drop("block"), min_dist, min_dist, size).filter(~F.col("home"))
            rival = F.struct("pos", _ranked(F.struct("pos", "height"), later_first).alias("rank"))
            rivals = near_edge.groupBy(*group).agg(F.collect_list(rival).alias("_rivals"))
        chosen = cut_lineage(_best_first(blocked, group, min_dist, later_first, keys, rivals), "chosen")
        n += 1
        if kept is not None:
            both = [*keys, "pos"]
            same = chosen.join(kept, both, "left_anti").isEmpty() and kept.join(chosen, both, "left_anti").isEmpty()
            if same:
                return chosen, n
        kept = chosen


def plateau_tops(df: DataFrame, height: Column, keys: Sequence[str] = SET) -> DataFrame:
    """Strict local maxima; a flat top counts once, at its middle sample."""
    z = df.select(*keys, "pos", height.alias("height"))
    halo = with_halo(z, 1, 0)
    runs = (
        halo.withColumn("_was", F.lag("height").over(block_window(keys)))
        .filter("home AND (_was IS NULL OR _was <> height)")
        .drop("block", "home")
    )
    around = neighbours(runs, ["height"], keys)
    return around.filter("_was < height AND next.height < height").select(
        *keys,
        F.floor((F.col("pos") + F.col("next.pos") - 1) / 2).cast("long").alias("pos"),
        "height",
    )


# --- prominence -------------------------------------------------------------
#
# For a top, look left and right to the nearest strictly higher sample (or the
# end of the track); its prominence is its height over the higher of the two
# minima passed. The samples of a track are the leaves of a tree of ``FAN`` children per
# node, and a node is one row that holds the range, highest and lowest value of its children. A look climbs from
# its leaf until a node further on holds a higher sample, then goes down to it; on both ways it meets one
# node per level, by a join on the node's number. So no row depends on a whole track.

FAN = 128
LEFT, RIGHT = -1, 1


def _levels(samples: DataFrame, keys: Sequence[str], fan: int) -> list[DataFrame]:
    """Nodes by level: keys, node, and kids (at, high, low); the last level has one node per track."""
    last = samples.agg(F.max("pos")).first()[0]
    kids, levels = samples.select(*keys, F.col("pos").alias("at"), F.col("height").alias("high"), F.col("height").alias("low")), []
    while True:
        node = F.floor(F.col("at") / fan).cast("long")
        grouped = kids.groupBy(*keys, node.alias("node")).agg(F.collect_list(F.struct("at", "high", "low")).alias("kids"))
        levels.append(cut_lineage(grouped, "levels"))
        last = None if last is None else last // fan
        if not last:
            return levels
        kids = levels[-1].select(*keys, F.col("node").alias("at"), F.array_max("kids.high").alias("high"), F.array_min("kids.low").alias("low"))


def _looked(looks: DataFrame, level: DataFrame, keys: Sequence[str], waits: Column, node: Column, beyond: Column | None) -> DataFrame:
    """``looks`` that wait, against the kids of their ``node``: ``hit`` is the nearest kid (further on than ``beyond``) that
    holds something higher, null for none, and ``low`` goes down to what is passed before it."""
    # looks that do not wait meet no node, and have numbers of their own so that they do not gather in one task
    own = looks.withColumn("node", F.when(waits, node).otherwise(-F.col("pos") - 1))
    met = own.join(level, [*keys, "node"], "left")
    side = F.col("side")
    ahead = F.coalesce(F.col("kids"), F.array().cast(level.schema["kids"].dataType))
    if beyond is not None:
        ahead = F.filter(ahead, lambda k: (k["at"] - beyond) * side > 0)
    met = met.withColumn("ahead", ahead).drop("kids")
    higher = F.filter("ahead", lambda k: k["high"] > F.col("height"))
    met = met.withColumn("nearest", F.array_min(F.transform(higher, lambda k: k["at"] * side)))
    passed = F.filter("ahead", lambda k: F.col("nearest").isNull() | (k["at"] * side < F.col("nearest")))
    lowest = F.array_min(F.transform(passed, lambda k: k["low"]))
    return met.withColumn("low", F.least("low", lowest)).withColumn("hit", F.col("nearest") * side).drop("ahead", "nearest", "node")


def prominences(df: DataFrame, tops: DataFrame, height: Column, keys: Sequence[str] = SET, fan: int | None = None) -> DataFrame:
    """Adds ``left_low``, ``right_low`` and ``prominence`` to ``tops``.

    ``df`` holds every sample of the tracks; ``height`` is the signal the tops were found on. Samples without
    height are passed over.
    """
    keys, fan = list(keys), fan or FAN
    samples = df.select(*keys, "pos", height.alias("height")).filter(F.col("height").isNotNull())
    levels = _levels(samples, keys, fan)
    looks = tops.select(*keys, "pos", "height", F.col("height").alias("low"), F.explode(F.array(F.lit(LEFT), F.lit(RIGHT))).alias("side"))
    none = F.lit(None).cast("long")
    # up: ``found`` is the node of ``level`` that holds the higher sample
    looks = looks.withColumns({"found": none, "level": F.lit(-1)})
    for k, level in enumerate(levels):
        # where the look stands on this level, and the node above it
        at = F.floor(F.col("pos") / fan**k).cast("long")
        looks = _looked(looks, level, keys, F.col("level") < 0, F.floor(at / fan).cast("long"), at)
        now = F.col("hit").isNotNull()
        looks = looks.withColumns({"found": F.when(now, F.col("hit")).otherwise(F.col("found")), "level": F.when(now, k).otherwise(F.col("level"))}).drop("hit")
    # down: through the nodes that hold it
    for k in range(len(levels) - 2, -1, -1):
        looks = _looked(looks, levels[k], keys, F.col("level") == k + 1, F.col("found"), None)
        now = F.col("hit").isNotNull()
        looks = looks.withColumns({"found": F.when(now, F.col("hit")).otherwise(F.col("found")), "level": F.when(now, k).otherwise(F.col("level"))}).drop("hit")
    lows = looks.groupBy(*keys, "pos").agg(
        F.min(F.when(F.col("side") == LEFT, F.col("low"))).alias("left_low"),
        F.min(F.when(F.col("side") == RIGHT, F.col("low"))).alias("right_low"),
    )
    return tops.join(lows, [*keys, "pos"]).withColumn(
        "prominence", F.col("height") - F.greatest("left_low", "right_low")
    )
