"""Frame-by-frame pose cleaning and lifter tracking as carried folds."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tracks
from .candidates import bootstrap_pick
from .carry import CHUNK, carried_fold
from .posture import JOINTS, L_ELBOW, L_HIP, L_SHOULDER, L_WRIST, R_ELBOW, R_HIP, R_SHOULDER, R_WRIST

TORSO = [L_SHOULDER, R_SHOULDER, L_HIP, R_HIP]
ARMS = ((L_ELBOW, R_ELBOW), (L_WRIST, R_WRIST))
TINY = 1e-3


@dataclass(frozen=True)
class CleaningProfile:
    """Which rules run and their limits, relative to shoulder width."""

    ema_alpha: float
    max_jump: float
    max_missing: int
    max_speed: float | None = None
    max_accel: float | None = None
    arm_gap: float | None = None
    arm_gap_px: float = 0.0
    stuck_window: int = 0
    stuck_move: float = 0.0
    stuck_limit: int = 0
    stuck_joints: tuple[int, ...] = ()
    min_size: float | None = None
    side_width_px: float = 20.0
    side_elbow_share: float = 0.45

    def with_(self, **changes) -> "CleaningProfile":
        return replace(self, **changes)


# Fixed values of the cleaning profiles.
SQUAT_CLEANING = CleaningProfile(0.30, 1.2, 12)
DEADLIFT_CLEANING = SQUAT_CLEANING
BENCH_CLEANING = CleaningProfile(
    0.30, 1.2, 12, arm_gap=0.30, arm_gap_px=15.0, stuck_window=15, stuck_move=0.015, stuck_limit=60, stuck_joints=tuple(range(JOINTS))
)
BENCH_V2_CLEANING = CleaningProfile(
    0.28, 1.0, 15, max_speed=0.9, max_accel=0.4, arm_gap=0.35, arm_gap_px=18.0,
    stuck_window=12, stuck_move=0.025, stuck_limit=50, stuck_joints=tuple(TORSO), min_size=0.25,
)


def _present(pose: np.ndarray) -> np.ndarray:
    return np.isfinite(pose).all(axis=1)


def _width(pose: np.ndarray) -> float:
    gap = pose[L_SHOULDER] - pose[R_SHOULDER]
    size = float(np.hypot(*gap))
    return size if np.isfinite(size) else 0.0


def pose_center(pose: np.ndarray) -> np.ndarray:
    ok = _present(pose)
    torso = [j for j in TORSO if ok[j]]
    use = torso if len(torso) >= 2 else np.flatnonzero(ok)
    return pose[use].mean(axis=0) if len(use) else np.full(2, np.nan)


class PoseCleaner:
    """State of one set: last pose, last velocities, recent steps, counters.

    A row offers ``cands``: dicts with x, y, score, size. Each step returns
    the cleaned x and y and whether a candidate was used.
    """

    def __init__(self, profile: CleaningProfile):
        self.p = profile

    # --- state as bytes, NaN in one form so that equal states compare equal

    def restore(self, state: bytes | None) -> None:
        n = max(self.p.stuck_window, 1)
        if state:
            flat = np.frombuffer(state, dtype=np.float64).copy()
        else:
            flat = np.concatenate([[0.0, 0.0], np.full(4 * JOINTS, np.nan), np.full(n * JOINTS, np.nan), np.zeros(2 * JOINTS)])
        self.started, self.missing = bool(flat[0]), int(flat[1])
        body = flat[2:]
        self.pose = body[: 2 * JOINTS].reshape(JOINTS, 2)
        self.velocity = body[2 * JOINTS : 4 * JOINTS].reshape(JOINTS, 2)
        self.steps = body[4 * JOINTS : (4 + n) * JOINTS].reshape(n, JOINTS)
        self.seen, self.stuck = body[(4 + n) * JOINTS :].reshape(2, JOINTS)

    def save(self) -> bytes:
        flat = np.concatenate(
            [[float(self.started), float(self.missing)], self.pose.ravel(), self.velocity.ravel(), self.steps.ravel(), self.seen, self.stuck]
        )
        flat[np.isnan(flat)] = np.nan
        return flat.tobytes()

    # --- rules

    def choose(self, cands) -> np.ndarray | None:
        if self.p.min_size is not None:
            cands = [c for c in cands if c["size"] is not None and c["size"] >= self.p.min_size]
        if len(cands) == 0:
            return None
        poses = [np.array([c["x"], c["y"]], dtype=np.float64).T for c in cands]
        center = pose_center(self.pose)
        if not (self.started and np.isfinite(center).all()):
            return poses[min(range(len(cands)), key=lambda i: (-cands[i]["score"], i))]
        gaps = [float(((pose_center(q) - center) ** 2).sum()) for q in poses]
        gaps = [g if np.isfinite(g) else np.inf for g in gaps]
        return poses[min(range(len(cands)), key=lambda i: (gaps[i], -cands[i]["score"], i))]

    def hold_jumps(self, pose: np.ndarray, width: float) -> np.ndarray:
        """Joints that jump further than the limit stay where they were."""
        with np.errstate(invalid="ignore"):
            far = ((pose - self.pose) ** 2).sum(axis=1) > (self.p.max_jump * width) ** 2
        return np.where(far[:, None], self.pose, pose)

    def hold_fast(self, pose: np.ndarray, width: float) -> np.ndarray:
        """Joints too fast, or changing velocity too much, stay where they were."""
        move = pose - self.pose
        with np.errstate(invalid="ignore"):
            fast = np.hypot(*move.T) > self.p.max_speed * width
            shaken = np.hypot(*(move - self.velocity).T) > self.p.max_accel * width
        return np.where((fast | shaken)[:, None], self.pose, pose)

    def part_arms(self, pose: np.ndarray, width: float) -> np.ndarray:
        """Left and right joints may not fall together; the one that moved more goes back."""
        limit = max(self.p.arm_gap_px, self.p.arm_gap * width) if width > TINY else self.p.arm_gap_px
        known, out = _present(self.pose), pose.copy()
        for a, b in ARMS:
            if not np.isfinite(out[[a, b]]).all() or ((out[a] - out[b]) ** 2).sum() >= limit**2:
                continue
            if known[a] and known[b]:
                moved = ((out[[a, b]] - self.pose[[a, b]]) ** 2).sum(axis=1)
                back = [a] if moved[0] > moved[1] else [b]
            else:
                back = [j for j in (a, b) if known[j]]
            out[back] = self.pose[back]
        return out

    def gate_stuck(self, pose: np.ndarray, width: float) -> np.ndarray:
        """Joints that hardly move are held, and dropped when held too long."""
        js = list(self.p.stuck_joints)
        step = np.hypot(*(pose[js] - self.pose[js]).T)
        self.steps[:-1, js] = self.steps[1:, js]
        self.steps[-1, js] = step
        recent = self.steps[:, js]
        n = np.isfinite(recent).sum(axis=0)
        mean = np.where(n > 0, np.nansum(recent, axis=0) / np.maximum(n, 1), np.inf)
        held = (n >= max(5, self.p.stuck_window // 3)) & (mean < self.p.stuck_move * width)
        self.stuck[js] = np.where(held, self.stuck[js] + 1, 0)
        out = pose.copy()
        for j, h in zip(js, held):
            if h:
                out[j] = np.nan if self.stuck[j] >= self.p.stuck_limit else self.pose[j]
        return out

    def side_on(self, pose: np.ndarray) -> bool:
        width = _width(pose)
        if width <= TINY or width < self.p.side_width_px:
            return True
        elbows = float(np.hypot(*(pose[L_ELBOW] - pose[R_ELBOW])))
        return bool(np.isfinite(elbows) and elbows / width < self.p.side_elbow_share)

    def step(self, row) -> tuple:
        pose = self.choose(row.cands if row.cands is not None else [])
        used = pose is not None
        if not used:
            self.missing += 1
            hold = self.started and self.missing <= self.p.max_missing
            pose = self.pose.copy() if hold else np.full((JOINTS, 2), np.nan)
        else:
            self.missing = 0
            pose[~_present(pose)] = np.nan
            if self.started:
                pose = self.follow(pose)
        self.pose, self.started = pose, True
        xs, ys = ([None if np.isnan(v) else float(v) for v in pose[:, k]] for k in (0, 1))
        return xs, ys, used

    def follow(self, pose: np.ndarray) -> np.ndarray:
        """All rules that compare with the previous pose, in their order."""
        width = _width(self.pose)
        if width > TINY:
            pose = self.hold_jumps(pose, width)
            if self.p.max_speed is not None:
                pose = self.hold_fast(pose, width)
        if self.p.max_speed is not None:
            move = pose - self.pose
            self.velocity = np.where(np.isfinite(move).all(axis=1)[:, None], move, self.velocity)
        if self.p.arm_gap is not None and not self.side_on(pose):
            pose = self.part_arms(pose, width)
        if self.p.stuck_window and width > TINY:
            pose = self.gate_stuck(pose, width)
        now, before = _present(pose), _present(self.pose)
        mixed = self.p.ema_alpha * pose + (1 - self.p.ema_alpha) * self.pose
        out = np.where((now & before)[:, None], mixed, pose)
        return np.where((~now & before)[:, None], self.pose, out)


class BoxFollower:
    """Follows one person by the overlap with the last box."""

    def restore(self, state: bytes | None) -> None:
        self.last = np.frombuffer(state, dtype=np.float64).copy() if state else None

    def save(self) -> bytes:
        return b"" if self.last is None else self.last.tobytes()

    def step(self, row) -> tuple:
        people = [] if row.people is None else list(row.people)
        if not people:
            return None, None
        boxes = np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in people], dtype=np.float64)
        known = np.isfinite(boxes).all(axis=1)
        sides = boxes[:, 2:] - boxes[:, :2]
        if self.last is None:
            value = np.where(known, np.maximum(1.0, sides.prod(axis=1)), -1.0)
            if not known.any():
                return None, None
        else:
            value = self.overlap(boxes)
        best = int(value.argmax())
        if known[best]:
            self.last = boxes[best]
        return int(people[best]["person"]), float(value[best])

    def overlap(self, boxes: np.ndarray) -> np.ndarray:
        low = np.maximum(boxes[:, :2], self.last[:2])
        high = np.minimum(boxes[:, 2:], self.last[2:])
        inter = np.maximum(0.0, high - low).prod(axis=1)
        size = np.maximum(0.0, boxes[:, 2:] - boxes[:, :2]).prod(axis=1)
        own = np.maximum(0.0, self.last[2:] - self.last[:2]).prod()
        union = size + own - inter
        return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


def candidate_frames(described: DataFrame, frames: DataFrame | None = None, score: str = "cand_score") -> DataFrame:
    """One row per frame with the array of its candidates.

    ``frames`` lists all frames where some have no candidate at all.
    """
    cell = F.struct("person", F.col(score).alias("score"), "size", "x", "y")
    packed = described.groupBy("set_id", "frame_index").agg(F.array_sort(F.collect_list(cell)).alias("cands"))
    if frames is not None:
        packed = frames.select("set_id", "frame_index").distinct().join(packed, ["set_id", "frame_index"], "left")
    return tracks.frame_positions(packed)


def bootstrap_states(described: DataFrame, profile: CleaningProfile, min_comp: float = 0.5, score: str = "cand_score") -> DataFrame:
    """Start states holding the best pose around the middle of each set."""
    best = bootstrap_pick(described, min_comp, score).drop("score")
    poses = best.join(described.select("set_id", "frame_index", "person", "x", "y"), ["set_id", "frame_index", "person"])

    def states(batches):
        for rows in batches:
            out = rows[["set_id"]].copy()
            made = []
            for x, y in zip(rows["x"], rows["y"]):
                cleaner = PoseCleaner(profile)
                cleaner.restore(None)
                pose = np.array([x, y], dtype=np.float64).T
                pose[~_present(pose)] = np.nan
                cleaner.pose, cleaner.started = pose, True
                made.append(cleaner.save())
            out["state"] = made
            yield out

    key_type = described.schema["set_id"].dataType.simpleString()
    return poses.select("set_id", "x", "y").mapInPandas(states, f"set_id {key_type}, state binary")


POSE_OUTPUT = "x array<double>, y array<double>, used boolean"


def clean_poses(
    described: DataFrame,
    profile: CleaningProfile = SQUAT_CLEANING,
    frames: DataFrame | None = None,
    bootstrap: bool = True,
    min_comp: float = 0.5,
    score: str = "cand_score",
    chunk: int = CHUNK,
) -> DataFrame:
    """Cleaned pose of every frame of every set, in frame order per set."""
    initial = bootstrap_states(described, profile, min_comp, score) if bootstrap else None
    return carried_fold(candidate_frames(described, frames, score), lambda: PoseCleaner(profile), POSE_OUTPUT, initial, chunk)


def follow_lifter(boxes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Person followed through all frames (set_id, frame_index, person, bbox)."""
    cell = F.struct("person", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")
    packed = boxes.groupBy("set_id", "frame_index").agg(F.array_sort(F.collect_list(cell)).alias("people"))
    return carried_fold(tracks.frame_positions(packed), BoxFollower, "person int, rank_value double", chunk=chunk)


def reseed_trace(trace: DataFrame, wrists: DataFrame, every: int = 12, lost_after: int = 2, max_gap: float = 120.0) -> DataFrame:
    """Replace tracked points by pose wrists where the track is checked or lost.

    ``trace``: set_id, pos, x, y; ``wrists``: set_id, pos, wx, wy. A frame is
    checked every ``every`` frames or after ``lost_after`` lost ones; the
    wrist is refused when it is far from a point that is not lost.
    """
    seen = tracks.bracket(trace, [], F.col("y").isNotNull()).withColumn(
        "lost", F.col("pos") - F.coalesce(F.col("prev.pos"), F.lit(0))
    )
    at = seen.drop("prev", "next", "n_valid").withColumn("block", tracks.block_of("pos"))
    posed = wrists.withColumn("block", tracks.block_of("pos"))
    joined = at.join(posed, ["set_id", "block", "pos"], "left").drop("block")
    due = (F.col("pos") > 0) & ((F.col("pos") % every == 0) | (F.col("lost") >= lost_after))
    gap = F.hypot(F.col("wx") - F.col("x"), F.col("wy") - F.col("y"))
    refused = F.col("y").isNotNull() & F.coalesce(gap > max_gap, F.lit(False)) & (F.col("lost") < lost_after)
    take = due & F.col("wy").isNotNull() & ~refused
    return joined.select(
        "set_id",
        "pos",
        F.when(take, F.col("wx")).otherwise(F.col("x")).alias("x"),
        F.when(take, F.col("wy")).otherwise(F.col("y")).alias("y"),
        take.alias("reseeded"),
    )
