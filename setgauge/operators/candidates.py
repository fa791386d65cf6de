"""Geometry of person candidates: completeness, boxes, scores, choices.

Candidate rows carry ``x``, ``y`` (and ``score``) as arrays of joints.
Functions take the frame size where they need it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, iou
from . import tracks
from .posture import JOINTS, L_ELBOW, L_HIP, L_SHOULDER, R_ELBOW, R_HIP, R_SHOULDER, pair_distance
from .quantiles import exact_percentiles
from .tracks import SET, block_of

# Fixed values of the candidate rules.
SCORE_FLOOR = 0.20
BOX_PAD = 3.0
BOOT_RANGE = 20
TORSO = (L_SHOULDER, R_SHOULDER, L_HIP, R_HIP)
WRIST_THRESHOLD = 0.35


def _joints(fn) -> Column:
    """Array over joints of ``fn(x, y)`` where the joint is present, else null."""
    return F.transform(
        F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y")),
        lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), fn(p["x"], p["y"])),
    )


def _present(fn) -> Column:
    return F.array_compact(_joints(fn))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def mask_low_scores(cands: DataFrame, floor: float = SCORE_FLOOR) -> DataFrame:
    """Joints scored below ``floor`` count as missing."""
    out = cands
    for name in ("x", "y"):
        out = out.withColumn(f"_{name}", F.zip_with(name, "score", lambda v, s: F.when(s >= floor, v)))
    return out.drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def completeness(width: float, height: float) -> Column:
    """Share of joints present and within 5 % of the frame."""
    inside = _present(
        lambda x, y: F.when(x.between(-0.05 * width, 1.05 * width) & y.between(-0.05 * height, 1.05 * height), F.lit(1))
    )
    return F.size(inside) / F.lit(float(JOINTS))


def shoulder_width() -> Column:
    return F.coalesce(pair_distance(L_SHOULDER, R_SHOULDER), F.lit(0.0))


def torso_center() -> Column:
    """Mean of the torso joints if two are present, else of all present joints."""
    zipped = _joints(lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    torso = F.array_compact(F.array(*[zipped[j] for j in TORSO]))
    chosen = F.when(F.size(torso) >= 2, torso).otherwise(F.array_compact(zipped))
    return F.struct(
        _mean(F.transform(chosen, lambda p: p["x"])).alias("x"), _mean(F.transform(chosen, lambda p: p["y"])).alias("y")
    )


def joint_box(width: float, height: float, pad: float = BOX_PAD) -> Column:
    """Box around the joints, widened by ``pad``, inside the frame; null for
    fewer than 4 joints or a side under 5."""
    xs, ys = _present(lambda x, y: x), _present(lambda x, y: y)

    def widened(values: Column, limit: float) -> tuple[Column, Column]:
        low, high = F.array_min(values), F.array_max(values)
        mid, half = (low + high) * 0.5, (high - low) * (pad * 0.5)
        return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(float(limit - 1)), mid + half)

    x1, x2 = widened(xs, width)
    y1, y2 = widened(ys, height)
    return F.when((F.size(xs) >= 4) & (x2 - x1 >= 5) & (y2 - y1 >= 5), box(x1, y1, x2, y2))


def person_size(width: float, height: float) -> Column:
    """Area of the joint box as a share of the frame; 0 for fewer than 4 joints."""
    xs, ys = _present(lambda x, y: x), _present(lambda x, y: y)
    span = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    return F.when(F.size(xs) >= 4, span / F.lit(float(width * height))).otherwise(F.lit(0.0))


def candidate_score(comp: Column, width: Column, mean_score: Column | None, size: Column | None = None) -> Column:
    total = comp + 0.25 * F.least(width / 60.0, F.lit(2.5))
    if mean_score is not None:
        total = total + F.coalesce(0.15 * mean_score, F.lit(0.0))
    return total if size is None else total + 0.3 * size


def describe_candidates(cands: DataFrame, width: float, height: float) -> DataFrame:
    """Masked joints plus comp, sw, center, size and score per candidate."""
    mean_score = _mean(F.array_compact("score"))
    sized = cands.withColumn("size", person_size(width, height)).withColumn("mean_score", mean_score)
    masked = mask_low_scores(sized)
    return (
        masked.withColumn("comp", completeness(width, height))
        .withColumn("sw", shoulder_width())
        .withColumn("center", torso_center())
        .withColumn("cand_score", candidate_score(F.col("comp"), F.col("sw"), F.col("mean_score")))
        .withColumn("cand_score_sized", F.col("cand_score") + 0.3 * F.col("size"))
    )


def pick_best(
    described: DataFrame, prev_x: Column | None = None, prev_y: Column | None = None, score: str = "cand_score", min_size: float | None = None
) -> DataFrame:
    """Per frame the candidate nearest to the previous centre (ties: better
    score), or the best scored one where no centre is known."""
    pool = described if min_size is None else described.filter(F.col("size") >= min_size)
    unknown = F.lit(None).cast("double")
    px, py = (unknown, unknown) if prev_x is None else (prev_x, prev_y)
    gap = F.pow(F.col("center.x") - px, 2) + F.pow(F.col("center.y") - py, 2)
    far = F.when(px.isNotNull() & py.isNotNull(), F.coalesce(gap, F.lit(float("inf")))).otherwise(F.lit(0.0))
    best = pool.groupBy("set_id", "frame_index").agg(
        F.min(F.struct(far.alias("d"), (-F.col(score)).alias("s"), F.col("person").alias("person"))).alias("_b")
    )
    return best.select("set_id", "frame_index", F.col("_b.person").alias("person"), F.col("_b.d").alias("dist2"), (-F.col("_b.s")).alias("score"))


def bootstrap_pick(described: DataFrame, min_comp: float = 0.5, score: str = "cand_score") -> DataFrame:
    """Best complete candidate within 20 frames of the middle of each set."""
    sizes = described.groupBy("set_id").agg(
        F.floor((F.max("frame_index") + 1) / 2).alias("_mid"), tracks.last_block("frame_index")
    )
    start = F.greatest(F.lit(0), F.col("_mid") - BOOT_RANGE)
    near = tracks.with_set_stats(described, sizes, pos="frame_index").filter(
        (F.col("frame_index") >= start) & (F.col("frame_index") <= start + 2 * BOOT_RANGE) & (F.col("comp") >= min_comp)
    )
    best = near.groupBy("set_id").agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col("frame_index").alias("f"), F.col("person").alias("p"))).alias("_b")
    )
    return best.select("set_id", F.col("_b.f").alias("frame_index"), F.col("_b.p").alias("person"), (-F.col("_b.s")).alias("score"))


def lifter_score(b: Column, wrist_scores: Column, width: float, height: float, chosen: Column | None = None) -> Column:
    """Area times wrist confidence, falling with distance from the frame centre."""
    known = b.isNotNull()
    size = F.when(known, F.greatest(F.lit(1.0), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))).otherwise(F.lit(1.0))
    half_w, half_h = width / 2.0, height / 2.0
    nx = F.when(known, (0.5 * (b["x1"] + b["x2"]) - half_w) / half_w).otherwise(F.lit(0.0))
    ny = F.when(known, (0.5 * (b["y1"] + b["y2"]) - half_h) / half_h).otherwise(F.lit(0.0))
    base = size * (1.5 + F.coalesce(wrist_scores, F.lit(0.0))) / (1.0 + 2.0 * (nx * nx + ny * ny))
    return base if chosen is None else base + 2.0 * iou(chosen, b)


def wrist_side(joints: DataFrame, left: int, right: int, threshold: float = WRIST_THRESHOLD) -> DataFrame:
    """Per set the wrist with the larger sum of good scores (right only if
    strictly larger) and its mean point."""

    def good(j: int, value: Column) -> Column:
        return F.when((F.col("joint") == j) & (F.col("score") >= threshold), value)

    sides = joints.filter(F.col("joint").isin(left, right)).groupBy("set_id").agg(
        *[
            e
            for name, j in (("l", left), ("r", right))
            for e in (
                F.coalesce(F.sum(good(j, F.col("score"))), F.lit(0.0)).alias(f"{name}q"),
                F.avg(good(j, F.col("x"))).alias(f"{name}x"),
                F.avg(good(j, F.col("y"))).alias(f"{name}y"),
            )
        ]
    )
    right_wins = F.col("rq") > F.col("lq")
    return sides.filter("lq > 0 OR rq > 0").select(
        "set_id",
        F.when(right_wins, "right").otherwise("left").alias("side"),
        F.when(right_wins, F.col("rx")).otherwise(F.col("lx")).alias("center_x"),
        F.when(right_wins, F.col("ry")).otherwise(F.col("ly")).alias("center_y"),
    )


def pose_wrist(preferred: str, left: int, right: int, threshold: float = WRIST_THRESHOLD) -> Column:
    """Point and score of the preferred wrist, else the other, else null."""

    def wrist(j: int) -> Column:
        return F.when(
            F.col("score")[j] >= threshold,
            F.struct(F.col("x")[j].alias("x"), F.col("y")[j].alias("y"), F.col("score")[j].alias("score")),
        )

    order = (right, left) if preferred == "right" else (left, right)
    return F.coalesce(wrist(order[0]), wrist(order[1]))


def likely_side_view(min_width: float = 20.0, elbow_share: float = 0.45) -> Column:
    sw = shoulder_width()
    elbows = pair_distance(L_ELBOW, R_ELBOW)
    return F.when((sw <= 1e-3) | (sw < min_width), F.lit(True)).otherwise(
        F.coalesce(elbows / sw < elbow_share, F.lit(False))
    )


def head_box(joints: DataFrame, head: Sequence[int], width: float, height: float, threshold: float = 0.2) -> DataFrame:
    """Box of the confident head joints, widened to the whole head, in whole
    pixels; null for fewer than three joints."""
    ok = F.col("joint").isin(*head) & (F.col("score") > threshold) & F.col("x").isNotNull() & F.col("y").isNotNull()
    per_frame = joints.groupBy("set_id", "frame_index").agg(
        F.count(F.when(ok, F.lit(1))).alias("_n"),
        *[f(F.when(ok, F.col(c))).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))],
    )
    w, h = F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy")
    edges = {
        "x1": F.greatest(F.lit(0.0), F.col("_lox") - w * 1.0),
        "y1": F.greatest(F.lit(0.0), F.col("_loy") - h * 1.5),
        "x2": F.least(F.lit(float(width)), F.col("_hix") + w * 1.0),
        "y2": F.least(F.lit(float(height)), F.col("_hiy") + h * 2.0),
    }
    return per_frame.select(
        "set_id", "frame_index", *[F.when(F.col("_n") >= 3, e.cast("int")).alias(n) for n, e in edges.items()]
    )


def drop_small_persons(boxes: DataFrame, size: str = "size", share: float = 0.6, keys: Sequence[str] = SET) -> DataFrame:
    """Clear boxes of frames whose person is below ``share`` of the set's
    median positive size. Sizes are paired with boxes by frame."""
    positive = boxes.filter(F.col(size) > 0)
    medians = exact_percentiles(positive, keys, F.col(size), {"_median": 0.5}, block_of("frame_index"))
    spans = boxes.groupBy(*keys).agg(tracks.last_block("frame_index")).join(medians, list(keys), "left")
    joined = tracks.with_set_stats(boxes, spans, keys, "frame_index")
    small = F.coalesce((F.col(size) > 0) & (F.col(size) < share * F.col("_median")), F.lit(False))
    out = joined
    for c in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(c, F.when(~small, F.col(c)))
    return out.drop("_median")


def fixed_crop(boxes: DataFrame, width: int, height: int, keys: Sequence[str] = SET) -> DataFrame:
    """One crop per set: median corners, largest box plus 20 %, inside the frame."""
    valid = boxes.filter(F.col("x1").isNotNull())
    named = valid.select(*keys, "frame_index", F.expr("stack(4, 'x1', x1, 'y1', y1, 'x2', x2, 'y2', y2) AS (corner, v)"))
    medians = exact_percentiles(named, [*keys, "corner"], F.col("v"), {"_m": 0.5}, block_of("frame_index"))
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("corner") == c, F.col("_m").cast("int"))).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    largest = valid.groupBy(*keys).agg(
        F.max(F.col("x2") - F.col("x1")).alias("_w"), F.max(F.col("y2") - F.col("y1")).alias("_h")
    )

    def whole(e: Column) -> Column:
        return F.floor(e).cast("int")

    out = wide.join(largest, list(keys))
    for a, size, limit in (("x", "_w", width), ("y", "_h", height)):
        out = (
            out.withColumn("_c", whole((F.col(f"m_{a}1") + F.col(f"m_{a}2")) / 2))
            .withColumn("_s", (F.col(size) * 1.2).cast("int"))
            .withColumn("_a", F.greatest(F.lit(0), F.col("_c") - whole(F.col("_s") / 2)))
            .withColumn("_b", F.least(F.lit(limit), F.col("_a") + F.col("_s")))
            .withColumn(f"crop_{a}1", F.when(F.col("_b") - F.col("_a") < F.col("_s"), F.greatest(F.lit(0), F.col("_b") - F.col("_s"))).otherwise(F.col("_a")))
            .withColumn(f"crop_{a}2", F.col("_b"))
        )
    return out.select(*keys, "crop_x1", "crop_y1", "crop_x2", "crop_y2")


def match_previous_box(boxes: DataFrame) -> DataFrame:
    """Per frame the person whose box overlaps the previous frame's reference
    box most (ties: first person); the largest person where none is known.

    ``boxes``: set_id, frame_index, person, bbox. The reference box of a
    frame is that of its largest person.
    """
    sized = boxes.withColumn("_area", F.greatest(F.lit(1.0), (F.col("bbox.x2") - F.col("bbox.x1")) * (F.col("bbox.y2") - F.col("bbox.y1"))))
    largest = sized.filter(F.col("bbox").isNotNull()).groupBy("set_id", "frame_index").agg(
        F.min(F.struct((-F.col("_area")).alias("a"), "person", "bbox")).alias("_l")
    )
    before = largest.select("set_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("_l.bbox").alias("_prev"))
    scored = sized.join(before, ["set_id", "frame_index"], "left")
    rank = F.when(F.col("_prev").isNull(), F.col("_area")).otherwise(iou(F.col("_prev"), F.col("bbox")))
    best = scored.filter(F.col("bbox").isNotNull() | F.col("_prev").isNotNull()).groupBy("set_id", "frame_index").agg(
        F.min(F.struct((-rank).alias("r"), F.col("person").alias("person"))).alias("_b"),
        F.max(F.col("_prev").isNotNull()).alias("matched"),
    )
    return best.select("set_id", "frame_index", F.col("_b.person").alias("person"), (-F.col("_b.r")).alias("rank_value"), "matched")
