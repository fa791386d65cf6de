"""Frame-signal and repetition queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.numbers import rounded as r6
from ..operators import peaks, reps, signals
from ..session import cut_lineage
from . import fixtures as fx
from .fixtures import cte
from .registry import query

# --- shared SQL steps --------------------------------------------------------

W = "OVER (PARTITION BY set_id ORDER BY pos)"
AHEAD = "OVER (PARTITION BY set_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

FILLED = {
    "marked": f"""SELECT *,
  last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) {W} AS p0, last_value(y IGNORE NULLS) {W} AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) {AHEAD} AS p1, first_value(y IGNORE NULLS) {AHEAD} AS y1,
  count(y) OVER (PARTITION BY set_id) AS n_valid, count(*) OVER (PARTITION BY set_id) AS n FROM frame_signal""",
    "filled": """SELECT *, CASE WHEN p0 IS NULL AND p1 IS NULL THEN 0 WHEN p0 IS NULL THEN y1 WHEN p1 IS NULL THEN y0
  WHEN p1 = p0 THEN y0 ELSE y0 + (y1 - y0) * (pos - p0) / (p1 - p0) END AS yf FROM marked""",
}
BOXED = FILLED | {
    "boxed": """SELECT *, CASE WHEN n_valid < 2 THEN y ELSE sum(yf) OVER (PARTITION BY set_id ORDER BY pos
  ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END AS ys FROM filled"""
}
MEDIANS = FILLED | {
    "medians": """SELECT f.set_id, f.pos, median(g.yf) AS m FROM filled f, range(-2, 3) k(d), filled g
  WHERE g.set_id = f.set_id AND g.pos = greatest(0, least(f.n - 1, f.pos + d)) GROUP BY f.set_id, f.pos"""
}
SMOOTH = MEDIANS | {
    "smooth": f"""SELECT set_id, pos, floor(1073741824 * list_reduce(list(m) {W},
  lambda a, x: CAST(0.35 AS DOUBLE) * x + CAST(0.65 AS DOUBLE) * a) + 0.5) / 1073741824 AS z FROM medians"""
}


def tops_sql(sign: int, half: int, share: float) -> dict[str, str]:
    return SMOOTH | {
        "signed": f"SELECT set_id, pos, z * {sign} AS z FROM smooth",
        "around": f"""SELECT *, lag(z) {W} AS zl, lead(z) {W} AS zr,
  min(z) OVER (PARTITION BY set_id ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS low,
  max(z) OVER (PARTITION BY set_id) - min(z) OVER (PARTITION BY set_id) AS span FROM signed""",
        "tops": f"SELECT * FROM around WHERE z > zl AND z >= zr AND z - low >= CAST({share} AS DOUBLE) * span",
    }


def thin_sql(source: str, dist: int | str, later: bool = False, name: str = "thinned") -> dict[str, str]:
    """``dist`` is a number of frames, or the column that holds it."""
    tie = "-pos" if later else "pos"
    return {
        name: f"""SELECT set_id, unnest(list_reduce(ps,
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda j: abs(j - x) < dist)) = 0 THEN list_append(acc, x) ELSE acc END,
  CAST([] AS BIGINT[]))) AS pos
  FROM (SELECT set_id, list(pos ORDER BY z DESC, {tie}) AS ps, max({dist}) AS dist FROM {source} GROUP BY set_id)"""
    }


STATS = BOXED | {
    "stats": """SELECT set_id, quantile_cont(ys, 0.05) AS top_y, quantile_cont(ys, 0.95) AS bottom_y,
  max(ys) FILTER (WHERE pos = 0) AS y_first, max(fps) AS fps, max(lift_code) AS lift_code, count(*) AS n FROM boxed GROUP BY set_id""",
    "styled": """SELECT *, bottom_y - top_y AS rom, CASE WHEN lift_code = 2 THEN 'BTB'
  WHEN abs(y_first - bottom_y) < abs(y_first - top_y) THEN 'BTB' ELSE 'TBT' END AS pattern FROM stats""",
    "oriented": """SELECT b.set_id, b.pos, CASE WHEN pattern = 'TBT' THEN ys ELSE -ys END AS z, s.fps, s.rom, s.n AS n_frames,
  s.pattern, CASE WHEN pattern = 'TBT' THEN top_y ELSE -bottom_y END + CAST(0.6 AS DOUBLE) * rom AS floor
  FROM boxed b JOIN styled s USING (set_id) WHERE ys IS NOT NULL""",
}
PLATEAU = STATS | {
    "flagged": f"SELECT *, CASE WHEN lag(z) {W} IS DISTINCT FROM z THEN 1 ELSE 0 END AS head FROM oriented",
    "runs": f"SELECT *, sum(head) {W} AS run FROM flagged",
    "flat": "SELECT set_id, run, min(pos) AS p0, max(pos) AS p1, max(z) AS z, max(floor) AS floor, max(fps) AS fps FROM runs GROUP BY set_id, run",
    "sided": """SELECT *, lag(z) OVER (PARTITION BY set_id ORDER BY run) AS zl,
  lead(z) OVER (PARTITION BY set_id ORDER BY run) AS zr FROM flat""",
    "deep": "SELECT set_id, (p0 + p1) // 2 AS pos, z, CAST(floor(fps * CAST(0.4 AS DOUBLE)) AS BIGINT) AS apart FROM sided WHERE zl < z AND zr < z AND z >= floor",
}
PROMINENT = (
    PLATEAU
    | thin_sql("deep", "apart", later=True, name="spaced")
    | {
        "tops": "SELECT set_id, pos, z FROM deep JOIN spaced USING (set_id, pos)",
        "walls": """SELECT t.set_id, t.pos, t.z,
  coalesce(max(o.pos) FILTER (WHERE o.pos < t.pos AND o.z > t.z), -1) AS l,
  coalesce(min(o.pos) FILTER (WHERE o.pos > t.pos AND o.z > t.z), 1000000000) AS r
  FROM tops t JOIN oriented o USING (set_id) GROUP BY t.set_id, t.pos, t.z""",
        "prominent": """SELECT w.set_id, w.pos, w.z,
  min(o.z) FILTER (WHERE o.pos > l AND o.pos <= w.pos) AS left_low, min(o.z) FILTER (WHERE o.pos < r AND o.pos >= w.pos) AS right_low,
  max(o.rom) AS rom, max(o.fps) AS fps, max(o.n_frames) AS n_frames, max(o.pattern) AS pattern
  FROM walls w JOIN oriented o USING (set_id) GROUP BY w.set_id, w.pos, w.z""",
    }
)
PEAKS = PROMINENT | {
    "found": "SELECT * FROM prominent WHERE z - greatest(left_low, right_low) >= CAST(0.15 AS DOUBLE) * rom",
    "fenced": """SELECT *, coalesce(lag(pos) OVER (PARTITION BY set_id ORDER BY pos), greatest(0, pos - CAST(floor(fps * 15) AS BIGINT))) AS f0,
  coalesce(lead(pos) OVER (PARTITION BY set_id ORDER BY pos), least(n_frames, pos + CAST(floor(fps * 15) AS BIGINT))) AS f1 FROM found""",
    "lows": """SELECT f.set_id, f.pos, min({'z': o.z, 'pos': o.pos}) FILTER (WHERE o.pos >= f0 AND o.pos < f.pos) AS pre,
  min(o.z) FILTER (WHERE o.pos >= f.pos AND o.pos < f1) AS post_low
  FROM fenced f JOIN oriented o USING (set_id) GROUP BY f.set_id, f.pos""",
    "bounds": """SELECT f.set_id, f.pos AS peak_idx, max(l.pre).pos AS start_idx, max(f.z) AS z, max(l.pre).z AS zs,
  min({'pos': o.pos, 'z': o.z}) AS post, max(f.fps) AS fps, max(f.pattern) AS pattern
  FROM fenced f JOIN lows l USING (set_id, pos) JOIN oriented o ON o.set_id = f.set_id AND o.pos >= f.pos AND o.pos < f1
  AND o.z <= post_low + CAST(0.03 AS DOUBLE) * o.rom WHERE l.pre IS NOT NULL GROUP BY f.set_id, f.pos""",
    "timed": """SELECT set_id, start_idx, peak_idx, post.pos AS end_idx, z - least(zs, post.z) AS depth_px, pattern,
  CASE WHEN pattern = 'TBT' THEN (post.pos - peak_idx) / fps ELSE (peak_idx - start_idx) / fps END AS duration_s FROM bounds""",
}
REPS = PEAKS | {
    "accepted": """SELECT set_id, unnest(list_reduce(
  list({'s': start_idx, 'e': end_idx, 'p': peak_idx} ORDER BY peak_idx) FILTER (WHERE duration_s >= CAST(0.2 AS DOUBLE)),
  lambda acc, x: CASE WHEN len(acc) = 0 OR x.s > acc[-1].e THEN list_append(acc, x) ELSE acc END,
  CAST([] AS STRUCT(s BIGINT, e BIGINT, p BIGINT)[]))).p AS peak_idx FROM timed GROUP BY set_id""",
    "reps": """SELECT t.*, row_number() OVER (PARTITION BY set_id ORDER BY peak_idx) AS rep_no
  FROM timed t JOIN accepted USING (set_id, peak_idx)""",
}
BAR = REPS | {
    "bar": """SELECT set_id, count(*) AS rep_count, arg_min(duration_s, rep_no) AS first_s, arg_max(duration_s, rep_no) AS last_s
  FROM reps GROUP BY set_id"""
}


def check(steps: dict[str, str], select: str, *views: str) -> str:
    return cte(*(views or ("frame_signal",)), extra=steps) + select


# --- S1..S9 -------------------------------------------------------------------


@query("gap_fill__S1", check(FILLED, "SELECT set_id, pos, round(yf, 6) + 0.0 AS y FROM filled"))
def gap_fill(spark, sf):
    return signals.fill_gaps(fx.frame_signal(spark, sf), "y").select("set_id", "pos", r6(F.col("y")).alias("y"))


@query("moving_average__S2", check(BOXED, "SELECT set_id, pos, round(ys, 6) + 0.0 AS y_smooth FROM boxed"))
def moving_average(spark, sf):
    out = signals.moving_average(fx.frame_signal(spark, sf), "y", "y_smooth")
    return out.select("set_id", "pos", r6(F.col("y_smooth")).alias("y_smooth"))


@query("centred_median__S3", check(MEDIANS, "SELECT set_id, pos, round(m, 6) + 0.0 AS y_median FROM medians"))
def centred_median(spark, sf):
    filled = signals.fill_gaps(fx.frame_signal(spark, sf), "y")
    return signals.median_filter(filled, "y", "m").select("set_id", "pos", r6(F.col("m")).alias("y_median"))


@query(
    "exponential_average__S4",
    check(
        FILLED
        | {
            "ema": f"""SELECT set_id, pos,
  list_reduce(list(yf) {W}, lambda a, x: CAST(0.35 AS DOUBLE) * x + CAST(0.65 AS DOUBLE) * a) AS z FROM filled"""
        },
        "SELECT set_id, pos, floor(z * 1073741824 + 0.5) / 1073741824 AS y_ema FROM ema",
    ),
)
def exponential_average(spark, sf):
    filled = signals.fill_gaps(fx.frame_signal(spark, sf), "y")
    return signals.ema_signal(filled, "y", "z").select("set_id", "pos", F.col("z").alias("y_ema"))


ALPHAS = (0.03, 0.28, 0.5, 0.9, 1.0)


@query(
    "exponential_averages__S4",
    check(
        FILLED
        | {
            f"ema{i}": f"""SELECT set_id, pos, {a} AS alpha,
  list_reduce(list(yf) {W}, lambda a, x: CAST({a} AS DOUBLE) * x + CAST({1.0 - a!r} AS DOUBLE) * a) AS z FROM filled"""
            for i, a in enumerate(ALPHAS)
        },
        " UNION ALL ".join(f"SELECT set_id, pos, CAST(alpha AS DOUBLE) AS alpha, round(z, 6) + 0.0 AS y_ema FROM ema{i}" for i in range(len(ALPHAS))),
    ),
)
def exponential_averages(spark, sf):
    signal = cut_lineage(fx.frame_signal(spark, sf).select("set_id", "pos", "y"), "signal")
    rows = signal.count()
    filled = cut_lineage(signals.fill_gaps(signal, "y", rows=rows), "filled")
    parts = [
        signals.ema_signal(filled, "y", "z", alpha, grid_bits=None, rows=rows).select("set_id", "pos", F.lit(alpha).alias("alpha"), r6(F.col("z")).alias("y_ema"))
        for alpha in ALPHAS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("smooth_signal__S1_S3_S4", check(SMOOTH, "SELECT set_id, pos, z AS y_smooth FROM smooth"))
def smooth_signal(spark, sf):
    out = signals.smooth_signal(fx.frame_signal(spark, sf), "y", "z")
    return out.select("set_id", "pos", F.col("z").alias("y_smooth"))


def _tops(spark, sf, sign, dist, share):
    smooth = signals.smooth_signal(fx.frame_signal(spark, sf), "y", "z").select("set_id", "pos", "z")
    return signals.local_tops(smooth, "z", dist, share, sign=sign)


TOP_COLUMNS = "SELECT set_id, pos, z AS height, z - low AS rise FROM tops"


@query("local_maxima__S5_S8", check(tops_sql(1, 3, 0.2), TOP_COLUMNS))
def local_maxima(spark, sf):
    return _tops(spark, sf, 1, 6, 0.2).select(
        "set_id", "pos", "height", "rise"
    )


@query("local_minima__S6_S8", check(tops_sql(-1, 5, 0.15), TOP_COLUMNS))
def local_minima(spark, sf):
    return _tops(spark, sf, -1, 10, 0.15).select(
        "set_id", "pos", "height", "rise"
    )


@query("peak_thinning__S7", check(tops_sql(1, 3, 0.05) | thin_sql("tops", 6), "SELECT set_id, pos FROM thinned"))
def peak_thinning(spark, sf):
    return peaks.thin_by_distance(_tops(spark, sf, 1, 6, 0.05), 6).select("set_id", "pos")


@query(
    "relative_threshold__S8",
    check(SMOOTH, "SELECT set_id, round(CAST(0.2 AS DOUBLE) * (max(z) - min(z)), 6) + 0.0 AS prominence FROM smooth GROUP BY set_id"),
)
def relative_threshold(spark, sf):
    smooth = signals.smooth_signal(fx.frame_signal(spark, sf), "y", "z")
    return smooth.groupBy("set_id").agg(r6(0.2 * (F.max("z") - F.min("z"))).alias("prominence"))


@query(
    "robust_range__S9",
    check(
        {},
        """SELECT set_id, round(quantile_cont(y, 0.05), 6) + 0.0 AS top_y, round(quantile_cont(y, 0.95), 6) + 0.0 AS bottom_y,
  round(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 6) + 0.0 AS rom FROM frame_signal GROUP BY set_id HAVING count(y) > 0""",
    ),
)
def robust_range(spark, sf):
    return reps.robust_range(fx.frame_signal(spark, sf)).select(
        "set_id", *[r6(F.col(c)).alias(c) for c in ("top_y", "bottom_y", "rom")]
    )


@query("start_pattern__S10", check(STATS, "SELECT set_id, pattern FROM styled"))
def start_pattern(spark, sf):
    smooth = signals.moving_average(fx.frame_signal(spark, sf), "y", "ys")
    return reps.trace_stats(smooth, "ys").select("set_id", "pattern")


def _peak_inputs(spark, sf):
    return reps.smooth_trace(fx.frame_signal(spark, sf))


@query(
    "prominence_bounds__J8",
    check(
        PROMINENT,
        """SELECT set_id, pos, round(left_low, 6) + 0.0 AS left_low, round(right_low, 6) + 0.0 AS right_low,
  round(z - greatest(left_low, right_low), 6) + 0.0 AS prominence FROM prominent""",
    ),
)
def prominence_bounds(spark, sf):
    smooth, stats = _peak_inputs(spark, sf)
    spaced = reps.spaced_tops(smooth, stats, value="y_smooth")
    out = peaks.prominences(reps.oriented_trace(smooth, stats, "y_smooth"), spaced, F.col("z"))
    return out.select("set_id", "pos", *[r6(F.col(c)).alias(c) for c in ("left_low", "right_low", "prominence")])


@query("full_peak_finder__S11", check(PEAKS, "SELECT set_id, pos, round(z, 6) + 0.0 AS height FROM found"))
def full_peak_finder(spark, sf):
    smooth, stats = _peak_inputs(spark, sf)
    return reps.find_peaks(smooth, stats, value="y_smooth").select("set_id", "pos", r6(F.col("height")).alias("height"))


@query("rep_boundaries__S12", check(PEAKS, "SELECT set_id, start_idx, peak_idx, end_idx FROM timed"))
def rep_boundaries(spark, sf):
    smooth, stats = _peak_inputs(spark, sf)
    found = reps.find_peaks(smooth, stats, value="y_smooth")
    return reps.rep_boundaries(smooth, stats, found, "y_smooth").select("set_id", "start_idx", "peak_idx", "end_idx")


@query("rep_validation__S13", check(REPS, "SELECT set_id, rep_no, start_idx, peak_idx, end_idx FROM reps"))
def rep_validation(spark, sf):
    return reps.bar_reps(fx.frame_signal(spark, sf)).select("set_id", "rep_no", "start_idx", "peak_idx", "end_idx")


@query(
    "rep_durations__S14",
    check(REPS, "SELECT set_id, rep_no, round(duration_s, 6) + 0.0 AS duration_s, round(depth_px, 6) + 0.0 AS depth_px, pattern FROM reps"),
)
def rep_durations(spark, sf):
    return reps.bar_reps(fx.frame_signal(spark, sf)).select(
        "set_id", "rep_no", r6(F.col("duration_s")).alias("duration_s"), r6(F.col("depth_px")).alias("depth_px"), "pattern"
    )


@query(
    "bar_summary__F9",
    check(
        BAR,
        """SELECT set_id, rep_count, round(first_s, 6) + 0.0 AS first_rep_duration_s, round(last_s, 6) + 0.0 AS last_rep_duration_s,
  round(CASE WHEN rep_count = 1 THEN first_s ELSE last_s - first_s END, 6) + 0.0 AS rep_change_s,
  round(last_s - first_s, 6) + 0.0 AS fatigue_s, rep_count = 1 AS one_rep_max FROM bar""",
    ),
)
def bar_summary(spark, sf):
    out = reps.bar_summary(reps.bar_reps(fx.frame_signal(spark, sf)))
    seconds = ["first_rep_duration_s", "last_rep_duration_s", "rep_change_s", "fatigue_s"]
    return out.select("set_id", "rep_count", *[r6(F.col(c)).alias(c) for c in seconds], "one_rep_max")
