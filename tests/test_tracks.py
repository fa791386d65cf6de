"""Block-wise operators against plain restatements, with small blocks so that
long sets span many of them."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from setgauge.operators import carry, peaks, pose_cleaning, posture, quantiles, reps, signals, tracks
from setgauge.session import fresh_path
from setgauge.streaming import pose_stream


def long_trace(n=700, sets=2, seed=0, missing=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sets):
        size = n if s == 0 else 60
        y = 100 + 40 * np.sin(np.arange(size) / 9.0) + rng.normal(0, 4, size)
        y[rng.random(size) < missing] = np.nan
        if s == 0:
            y[100:190] = np.nan  # a gap longer than a block
        rows += [(s, i, None if np.isnan(v) else float(v), 30.0, s) for i, v in enumerate(y)]
    return rows


@pytest.fixture(scope="module")
def trace(spark):
    return spark.createDataFrame(long_trace(), "set_id int, pos long, y double, fps double, lift_code int").cache()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(tracks, "BLOCK", 64)
    monkeypatch.setattr(signals, "SMALL_BLOCK", 256)
    monkeypatch.setattr(peaks, "FAN", 4)


def by_set(df, value):
    out = {}
    for r in df.orderBy("set_id", "pos").collect():
        out.setdefault(r["set_id"], []).append(r[value])
    return out


def filled(values):
    y = np.array([np.nan if v is None else v for v in values])
    good = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(good), y[good])


def test_positions_follow_order(spark, small_blocks):
    df = spark.createDataFrame([(1, i * 3) for i in range(500)], "set_id int, frame_index int")
    got = tracks.frame_positions(df.orderBy(F.rand(1))).orderBy("frame_index").collect()
    assert [r["pos"] for r in got] == list(range(500))


def test_fill_and_box(trace, small_blocks):
    raw = by_set(trace, "y")
    got = by_set(signals.moving_average(trace, "y", "s"), "s")
    for s, values in raw.items():
        want = np.convolve(filled(values), np.ones(7) / 7, mode="same")
        np.testing.assert_allclose(got[s], want, rtol=1e-12)


def test_fill_is_idempotent(trace, small_blocks):
    once = signals.fill_gaps(trace, "y")
    assert by_set(once, "y") == by_set(signals.fill_gaps(once, "y"), "y")


def test_smooth_chain(trace, small_blocks):
    got = by_set(signals.smooth_signal(trace, "y", "z"), "z")
    for s, values in by_set(trace, "y").items():
        y = filled(values)
        padded = np.pad(y, 2, mode="edge")
        med = np.array([np.median(padded[i : i + 5]) for i in range(len(y))])
        want = [med[0]]
        for v in med[1:]:
            want.append(0.35 * v + 0.65 * want[-1])
        np.testing.assert_allclose(got[s], want, atol=2e-9)


def test_hold_limit(spark, small_blocks):
    rows = [(0, i, 1.0 if i in (0, 60) else None) for i in range(130)]
    df = spark.createDataFrame(rows, "set_id int, pos long, y double")
    held = by_set(signals.hold_last(df, "y", "y", 12), "y")[0]
    assert [i for i, v in enumerate(held) if v is not None] == [*range(13), *range(60, 73)]


def greedy(pos, height, dist, later):
    order = sorted(range(len(pos)), key=lambda i: (-height[i], -pos[i] if later else pos[i]))
    kept = []
    for i in order:
        if all(abs(pos[i] - k) >= dist for k in kept):
            kept.append(pos[i])
    return sorted(kept)


@pytest.mark.parametrize("kind", ["noise", "ramp", "ties"])
@pytest.mark.parametrize("later", [False, True])
def test_thinning_is_the_greedy_choice(spark, small_blocks, kind, later):
    rng = np.random.default_rng(5)
    pos = np.flatnonzero(rng.random(1500) < 0.3)
    height = {"noise": rng.random(len(pos)), "ramp": np.arange(len(pos)) * 1.0, "ties": rng.integers(0, 4, len(pos)) * 1.0}[kind]
    df = spark.createDataFrame([(7, int(p), float(h)) for p, h in zip(pos, height)], "set_id int, pos long, height double")
    got = sorted(r["pos"] for r in peaks.thin_by_distance(df, 9, later_first=later).collect())
    assert got == greedy(pos.tolist(), height.tolist(), 9, later)


def test_prominences_over_many_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    z = np.cumsum(rng.integers(-3, 4, 1500)).astype(float)
    tops = np.flatnonzero((z[1:-1] > z[:-2]) & (z[1:-1] > z[2:])) + 1
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(z)], "set_id int, pos long, z double")
    marks = spark.createDataFrame([(1, int(i), float(z[i])) for i in tops], "set_id int, pos long, height double")
    got = {r["pos"]: (r["left_low"], r["right_low"]) for r in peaks.prominences(df, marks, F.col("z")).collect()}
    for i in tops:
        lows = []
        for step in (-1, 1):
            j, low = i, z[i]
            while 0 <= j < len(z) and z[j] <= z[i]:
                low, j = min(low, z[j]), j + step
            lows.append(low)
        assert got[i] == tuple(lows)


def stack_lows(z):
    """Lowest value up to the next higher one on the left, for every sample, in one pass."""
    lows, stack = np.empty(len(z)), []
    for i, v in enumerate(z):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        lows[i] = low
        stack.append((v, low))
    return lows


@pytest.mark.parametrize("n", [1, 2, 130, 1_000_000])
def test_prominences_of_a_rising_zigzag(spark, n):
    """Every top is higher than all before it, so every look to the left goes to the beginning."""
    z = np.arange(n) * 0.25 + np.where(np.arange(n) % 2 == 1, 2.0, 0.0)
    df = spark.range(n).select(F.lit(1).alias("set_id"), F.col("id").alias("pos"), (F.col("id") * 0.25 + F.when(F.col("id") % 2 == 1, 2.0).otherwise(0.0)).alias("z"))
    tops = df.filter("pos % 2 = 1").withColumnRenamed("z", "height")
    left, right = stack_lows(z), stack_lows(z[::-1])[::-1]
    got = peaks.prominences(df, tops, F.col("z")).orderBy("pos").select("left_low", "right_low").toPandas()
    assert got["left_low"].tolist() == left[1::2].tolist() and got["right_low"].tolist() == right[1::2].tolist()


def test_rounds_of_thinning(spark):
    """A slope of tops over many blocks waits for its upper end; tops without one are settled at once."""
    rounds = []
    slope = spark.range(4000).select(F.lit(1).alias("set_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("height"))
    got = sorted(r["pos"] for r in peaks.thin_by_distance(slope, 9, rounds=rounds).collect())
    assert got == list(range(3999, -1, -9))[::-1] and rounds[0] <= 4000 / (32 * 9) + 3
    rounds = []
    waves = slope.withColumn("height", F.pmod(F.xxhash64("pos"), F.lit(1000)).cast("double"))
    peaks.thin_by_distance(waves, 9, rounds=rounds).collect()
    assert rounds in ([], [2], [3])


def test_percentiles_are_exact(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 40)
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(0, 5, 3000), 1: rng.integers(0, 5, 700) * 1.0, 2: np.array([3.0]), 3: np.array([1.0, 2.0])}
    rows = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, pos long, v double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0, "low": 0.0}
    got = quantiles.exact_percentiles(df, ["g"], F.col("v"), probs, tracks.block_of("pos")).collect()
    assert len(got) == 4
    for r in got:
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(groups[r["g"]], p * 100), abs=1e-12)


def test_reps_do_not_depend_on_block_size(spark, trace, monkeypatch):
    whole = {tuple(r) for r in reps.bar_reps(trace).collect()}
    monkeypatch.setattr(tracks, "BLOCK", 64)
    monkeypatch.setattr(peaks, "FAN", 4)
    cut = {tuple(r) for r in reps.bar_reps(trace).collect()}
    assert len(whole) > 5
    assert cut == whole


@pytest.mark.parametrize("parts", [1, 7])
def test_wide_percentiles_are_exact(spark, small_blocks, parts):
    """Every column against numpy: signs, ties, both zeros, sizes far apart, missing values, columns without any."""
    rng = np.random.default_rng(4)
    n = 2000
    columns = {
        "a": rng.normal(0, 5, n), "b": rng.integers(0, 4, n) * 1.0, "c": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n),
        "d": np.where(rng.random(n) < 0.5, -0.0, 0.0), "e": np.full(n, np.nan), "f": rng.random(n) * 1e-9 + 5, "g": np.where(rng.random(n) < 0.9, np.inf, 1.0),
    }
    group = np.where(np.arange(n) < 1500, 0, np.where(np.arange(n) < 1999, 1, 2))  # one set of a single row
    missing = {name: rng.random(n) < 0.2 for name in columns}
    missing["e"][:] = True
    rows = [(int(group[i]), i, *(None if missing[c][i] else float(v[i]) for c, v in columns.items())) for i in range(n)]
    df = spark.createDataFrame(rows, "set_id long, pos long, " + ", ".join(f"{c} double" for c in columns)).repartition(parts)
    probs = {"p0": 0.0, "q10": 0.1, "median": 0.5, "q75": 0.75, "p100": 1.0}
    got = {(r["set_id"], r["c"]): r for r in quantiles.wide_percentiles(df, "set_id", list(columns), probs, tracks.block_of("pos")).collect()}
    for g in (0, 1, 2):
        for c, name in enumerate(columns):
            values = columns[name][(group == g) & ~missing[name]]
            assert ((g, c) in got) == bool(len(values))
            for p, share in probs.items() if len(values) else ():
                order, place = np.sort(values), share * (len(values) - 1)
                low, high = order[int(place)], order[min(int(place) + 1, len(values) - 1)]
                want = low + (high - low) * (place - int(place)) if np.isfinite([low, high]).all() else None
                if want is not None:
                    assert math.isclose(got[g, c][p], want, rel_tol=1e-12), (g, name, p)
    assert quantiles.wide_percentiles(df.limit(0), "set_id", list(columns), probs, tracks.block_of("pos")).collect() == []


def test_ordered_bits():
    values = np.array([-np.inf, -1e300, -2.0, -1e-320, -0.0, 0.0, 1e-320, 0.5, 2.0, np.inf, np.nan])
    bits = quantiles.ordered_bits(values)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5] and (np.delete(np.diff(bits), 4) > 0).all()
    np.testing.assert_array_equal(quantiles.from_ordered_bits(bits), values + 0.0)


def test_interpolation_spans_blocks(spark, small_blocks):
    rows = [(1, i, float(i % 37), 300) for i in range(0, 290, 70)]
    df = spark.createDataFrame(rows, "set_id int, frame_index int, x double, last_frame int")
    got = signals.interpolate_track(df, ["x"], ["set_id"], "last_frame").orderBy("frame_index").collect()
    at = [r[1] for r in rows]
    want = np.interp(np.arange(301), at, [r[2] for r in rows])
    np.testing.assert_allclose([r["x"] for r in got], want, atol=1e-9)


def test_carried_fold_is_exact(spark):
    class Counter:
        """Never forgets: each frame's result needs all frames before it."""

        def restore(self, state):
            self.total = int(state.decode()) if state else 0

        def step(self, row):
            self.total += row.v
            return (self.total,)

        def save(self):
            return str(self.total).encode()

    rows = [(s, i, i, (i * 7 + s) % 5) for s, n in ((0, 95), (1, 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "set_id int, frame_index int, pos long, v int")
    got = carry.carried_fold(df, Counter, "total long", chunk=20).orderBy("set_id", "frame_index").toPandas()
    want = pd.DataFrame(rows, columns=["s", "f", "p", "v"]).groupby("s").v.cumsum()
    assert got.total.tolist() == want.tolist()


def test_normalized_pose_ignores_place_and_size(spark):
    rng = np.random.default_rng(1)
    xs, ys = rng.random((2, 16)).tolist()
    rows = [(0, 0, xs, ys), (0, 1, [v * 3 + 10 for v in xs], [v * 3 - 4 for v in ys])]
    df = spark.createDataFrame(rows, "set_id int, frame_index int, x array<double>, y array<double>")
    a, b = posture.normalize_pose(df).orderBy("frame_index").select("nx", "ny").collect()
    np.testing.assert_allclose(a["nx"], b["nx"], atol=1e-12)
    np.testing.assert_allclose(a["ny"], b["ny"], atol=1e-12)


def pose_rows(n=130, seed=9):
    """Candidate frames of one long set: two people, noise, gaps, empty frames."""
    rng = np.random.default_rng(seed)
    base = rng.random((16, 2)) * 200 + 100
    base[4], base[5] = (120, 150), (220, 150)
    base[6], base[7], base[8], base[9] = (110, 200), (230, 200), (118, 260), (126, 262)
    rows = []
    for i in range(n):
        if i % 29 in (3, 4) or 60 <= i < 80:
            continue
        cands = []
        for person in (0, 1):
            pose = base + person * 90 + rng.normal(0, 3, (16, 2))
            if i % 17 == 0:
                pose[10] += 400
            pose[rng.random(16) < 0.06] = np.nan
            xs, ys = ([None if np.isnan(v) else float(v) for v in pose[:, k]] for k in (0, 1))
            cands.append((person, float(rng.random()), 0.3 if person == 0 else 0.2, xs, ys))
        rows.append((0, i, cands))
    return rows


class PlainCleaner:
    """The cleaning rules restated joint by joint for the test."""

    def __init__(self, p):
        self.p, self.prev, self.missing = p, None, 0
        self.vel = [None] * 16
        self.hist = [[] for _ in range(16)]
        self.stuck = [0] * 16

    @staticmethod
    def ok(q):
        return np.isfinite(q).all()

    @staticmethod
    def center(k):
        torso = [k[j] for j in (4, 5, 10, 11) if np.isfinite(k[j]).all()]
        if len(torso) >= 2:
            return np.mean(torso, axis=0)
        rest = [q for q in k if np.isfinite(q).all()]
        return np.mean(rest, axis=0) if rest else np.array([np.nan, np.nan])

    def width(self, k):
        return float(np.linalg.norm(k[4] - k[5])) if self.ok(k[4]) and self.ok(k[5]) else 0.0

    def step(self, cands):
        p, prev = self.p, self.prev
        if p.min_size is not None:
            cands = [c for c in cands if c[2] >= p.min_size]
        poses = [(np.array([c[3], c[4]], dtype=float).T, c[1]) for c in cands]
        poses = [(np.where(np.isfinite(k).all(axis=1)[:, None], k, np.nan), s) for k, s in poses]
        if not poses:
            self.missing += 1
            out = prev.copy() if prev is not None and self.missing <= p.max_missing else np.full((16, 2), np.nan)
            self.prev = out
            return out
        self.missing = 0
        mid = None if prev is None else self.center(prev)
        if mid is not None and self.ok(mid):
            cur = sorted(poses, key=lambda t: (((self.center(t[0]) - mid) ** 2).sum(), -t[1]))[0][0]
        else:
            cur = max(poses, key=lambda t: t[1])[0]
        if prev is not None:
            cur = self.rules(prev, cur.copy())
        self.prev = cur
        return cur

    def rules(self, prev, cur):
        p, sw = self.p, self.width(prev)
        both = [j for j in range(16) if self.ok(prev[j]) and self.ok(cur[j])]
        if sw > 1e-3:
            for j in both:
                if np.linalg.norm(cur[j] - prev[j]) > p.max_jump * sw:
                    cur[j] = prev[j]
            if p.max_speed is not None:
                for j in both:
                    v = cur[j] - prev[j]
                    late = self.vel[j] is not None and np.linalg.norm(v - self.vel[j]) > p.max_accel * sw
                    if np.linalg.norm(v) > p.max_speed * sw or late:
                        cur[j] = prev[j]
        if p.max_speed is not None:
            for j in both:
                self.vel[j] = cur[j] - prev[j]
        if p.arm_gap is not None and not self.side(cur):
            limit = max(p.arm_gap_px, p.arm_gap * sw) if sw > 1e-3 else p.arm_gap_px
            for a, b in ((6, 7), (8, 9)):
                if self.ok(cur[a]) and self.ok(cur[b]) and np.linalg.norm(cur[a] - cur[b]) < limit:
                    if self.ok(prev[a]) and self.ok(prev[b]):
                        worse = a if np.linalg.norm(cur[a] - prev[a]) > np.linalg.norm(cur[b] - prev[b]) else b
                        cur[worse] = prev[worse]
                    else:
                        for j in (a, b):
                            if self.ok(prev[j]):
                                cur[j] = prev[j]
        if p.stuck_window and sw > 1e-3:
            for j in p.stuck_joints:
                self.hist[j] = (self.hist[j] + [np.linalg.norm(cur[j] - prev[j])])[-p.stuck_window :]
                seen = [h for h in self.hist[j] if np.isfinite(h)]
                if len(seen) >= max(5, p.stuck_window // 3) and np.mean(seen) < p.stuck_move * sw:
                    self.stuck[j] += 1
                    cur[j] = prev[j] if self.stuck[j] < p.stuck_limit else np.nan
                else:
                    self.stuck[j] = 0
        for j in range(16):
            if self.ok(cur[j]) and self.ok(prev[j]):
                cur[j] = p.ema_alpha * cur[j] + (1 - p.ema_alpha) * prev[j]
            elif self.ok(prev[j]):
                cur[j] = prev[j]
        return cur

    def side(self, k):
        sw = self.width(k)
        if sw <= 1e-3 or sw < 20:
            return True
        return bool(self.ok(k[6]) and self.ok(k[7]) and np.linalg.norm(k[6] - k[7]) / sw < 0.45)


CANDS = "set_id int, frame_index int, cands array<struct<person int, score double, size double, x array<double>, y array<double>>>"
PROFILES = {
    "squat": pose_cleaning.SQUAT_CLEANING,
    "bench": pose_cleaning.BENCH_CLEANING.with_(stuck_move=0.03, stuck_limit=6),
    "bench_v2": pose_cleaning.BENCH_V2_CLEANING.with_(stuck_move=0.03, stuck_limit=6),
}


@pytest.mark.parametrize("name", list(PROFILES))
def test_pose_cleaning_matches_plain_rules(spark, name):
    rows = pose_rows()
    df = spark.createDataFrame(rows, CANDS)
    frames = spark.range(130).selectExpr("0 AS set_id", "CAST(id AS INT) AS frame_index")
    placed = tracks.frame_positions(frames.join(df, ["set_id", "frame_index"], "left"))
    profile = PROFILES[name]
    plain, cands = PlainCleaner(profile), {r[1]: r[2] for r in rows}
    want = [plain.step(cands.get(i, [])) for i in range(130)]
    for chunk in (4096, 25):
        out = carry.carried_fold(placed, lambda: pose_cleaning.PoseCleaner(profile), pose_cleaning.POSE_OUTPUT, chunk=chunk)
        got = out.orderBy("frame_index").collect()
        assert len(got) == 130
        for r, w in zip(got, want):
            np.testing.assert_allclose(np.array([r["x"], r["y"]], dtype=float).T, w, atol=1e-9)


def test_stream_equals_batch(spark):
    df = spark.createDataFrame(pose_rows(60), CANDS)
    batch = carry.carried_fold(
        tracks.frame_positions(df), lambda: pose_cleaning.PoseCleaner(PROFILES["bench_v2"]), pose_cleaning.POSE_OUTPUT
    )
    path = fresh_path(spark, "stream_in")
    for low, high in ((0, 25), (25, 60)):  # one file per stretch of frames
        df.filter(F.col("frame_index").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their time
    out = pose_stream.run_clean_poses(spark, path, df.schema, PROFILES["bench_v2"], files=1)
    key = ["set_id", "frame_index", "x", "y"]
    assert sorted(map(str, out.select(key).collect())) == sorted(map(str, batch.select(key).collect()))


def test_lifter_track_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        for person in range(3):
            x, y = rng.random(2) * 30 + person * 25
            rows.append((0, i, person, (float(x), float(y), float(x + 30), float(y + 40))))
    df = spark.createDataFrame(rows, "set_id int, frame_index int, person int, bbox struct<x1 double, y1 double, x2 double, y2 double>")
    whole, cut = (sorted(map(tuple, pose_cleaning.follow_lifter(df, c).collect())) for c in (4096, 13))
    assert whole == cut and len({r[2] for r in whole}) >= 1
