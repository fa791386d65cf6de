"""Per-set queries: keys, facial summaries, merges, features, imputation, ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, labels
from ..functions.numbers import rounded as r6
from ..functions.numbers import snap
from ..operators import assemble as asm
from ..operators import facial, features, impute, reports, signals
from ..session import cut_lineage, fresh_path
from ..sources import frames
from . import fixtures as fx
from .fixtures import AUS, cte
from .registry import query


def with_steps(steps: dict[str, str], select: str, *views: str) -> str:
    return cte(*views, extra=steps) + select


def grid_sql(expr: str, name: str) -> str:
    """Comparison on a binary grid: products of short decimals often sit
    exactly between two decimal places, never between two grid points."""
    return f"floor(CAST({expr} AS DOUBLE) * 1048576 + 0.5) / 1048576 AS {name}"


def _gridded(df: DataFrame, names, *keep) -> DataFrame:
    return df.select(*keep, *[snap(F.col(c).cast("double"), 20).alias(c) for c in names])



def _rounded(df: DataFrame, names, *keep) -> DataFrame:
    return df.select(*keep, *[r6(F.col(c)).alias(c) for c in names])


# --- keys and scalars ----------------------------------------------------------------

NAMES = {
    "named": """SELECT set_no, set_id, CASE set_no % 6 WHEN 0 THEN concat(set_id, '.mp4') WHEN 1 THEN concat(' ', lower(set_id), '.tar.gz ')
  WHEN 2 THEN NULL WHEN 3 THEN 'clip' WHEN 4 THEN concat('Hack Machine ', set_no) ELSE concat('DEADLIFT', set_no, '.mov') END AS file
  FROM set_label"""
}


def _names(spark, sf) -> DataFrame:
    no = F.col("set_no")
    text = no.cast("string")
    file = (
        F.when(no % 6 == 0, F.concat("set_id", F.lit(".mp4")))
        .when(no % 6 == 1, F.concat(F.lit(" "), F.lower("set_id"), F.lit(".tar.gz ")))
        .when(no % 6 == 3, "clip")
        .when(no % 6 == 4, F.concat(F.lit("Hack Machine "), text))
        .when(no % 6 == 5, F.concat(F.lit("DEADLIFT"), text, F.lit(".mov")))
    )
    return fx.set_label(spark, sf).select("set_no", "set_id", file.alias("file"))


@query("file_stem__P1", with_steps(NAMES, r"SELECT set_no, coalesce(trim(regexp_replace(file, '([^./])\.[^./]*$', '\1')), '') AS stem FROM named", "set_label"))
def file_stem(spark, sf):
    return _names(spark, sf).select("set_no", keys.file_stem(F.col("file")).alias("stem"))


@query(
    "first_number__P2",
    with_steps(NAMES, r"SELECT set_no, coalesce(TRY_CAST(nullif(regexp_extract(file, '\d+', 0), '') AS BIGINT), 1000000000) AS n FROM named", "set_label"),
)
def first_number(spark, sf):
    return _names(spark, sf).select("set_no", keys.first_number(F.col("file")).alias("n"))


CODE = """CASE WHEN lower(file) LIKE '%bench%' THEN 0 WHEN lower(file) LIKE '%squat%' THEN 1 WHEN lower(file) LIKE '%dead%' THEN 2 ELSE 3 END"""


@query("lift_code__P3", with_steps(NAMES, f"SELECT set_no, {CODE} AS code FROM named", "set_label"))
def lift_code(spark, sf):
    return _names(spark, sf).select("set_no", keys.lift_code(F.col("file")).alias("code"))


MOVEMENT = """CASE WHEN lower(file) LIKE '%bench%' THEN 'Bench Press' WHEN lower(file) LIKE '%squat%' THEN 'Squat' WHEN lower(file) LIKE '%deadlift%' THEN 'Deadlift' END"""


@query(
    "movement__P4",
    with_steps(
        NAMES,
        f"""SELECT set_no, CASE WHEN set_no % 10 = 0 THEN 'Bench Press' WHEN set_no % 10 = 1 THEN NULL ELSE {MOVEMENT} END AS movement,
  set_no % 10 = 1 OR (set_no % 10 > 1 AND {MOVEMENT} IS NULL) AS rejected FROM named""",
        "set_label",
    ),
)
def movement(spark, sf):
    no = F.col("set_no") % 10
    given = F.when(no == 0, "  bench PRESS ").when(no == 1, "clean")
    shown = keys.movement(given, F.col("file"))
    return _names(spark, sf).select("set_no", shown.alias("movement"), shown.isNull().alias("rejected"))


@query(
    "movement_code__P5",
    with_steps(
        NAMES, f"SELECT set_no, CASE {MOVEMENT} WHEN 'Bench Press' THEN 0 WHEN 'Squat' THEN 1 WHEN 'Deadlift' THEN 2 ELSE 1 END AS code FROM named", "set_label"
    ),
)
def movement_code(spark, sf):
    return _names(spark, sf).select("set_no", keys.movement_code(keys.movement_from_name(F.col("file"))).alias("code"))


@query(
    "exercise__P6",
    with_steps(
        NAMES | {"w": r"SELECT set_no, file, regexp_split_to_array(trim(file), '\s+') AS words FROM named"},
        """SELECT set_no, CASE WHEN lower(file) LIKE '%squat%' THEN 'squat' WHEN lower(file) LIKE '%deadlift%' THEN 'deadlift'
  WHEN lower(file) LIKE '%bench%' THEN 'bench_press' WHEN len(words) >= 2 THEN lower(array_to_string(words[1:len(words) - 1], ' '))
  ELSE 'unknown' END AS exercise FROM w""",
        "set_label",
    ),
)
def exercise(spark, sf):
    return _names(spark, sf).select("set_no", keys.exercise(F.col("file")).alias("exercise"))


@query(
    "client_lift__P7",
    with_steps(
        {},
        """SELECT set_no, CASE lower(v) WHEN 'squat' THEN 'Squat' WHEN 'bench press' THEN 'Bench Press' WHEN 'bench' THEN 'Bench Press'
  WHEN 'deadlift' THEN 'Deadlift' END AS model_lift, CASE lower(v) WHEN 'squat' THEN 'Squat' WHEN 'bench' THEN 'Bench Press'
  WHEN 'deadlift' THEN 'Deadlift' ELSE v END AS shown
  FROM (SELECT set_no, CASE set_no % 4 WHEN 0 THEN upper(lift) WHEN 1 THEN 'bench' WHEN 2 THEN 'Row' ELSE lift END AS v FROM set_label) t""",
        "set_label",
    ),
)
def client_lift(spark, sf):
    k = F.col("set_no") % 4
    v = F.when(k == 0, F.upper("lift")).when(k == 1, "bench").when(k == 2, "Row").otherwise(F.col("lift"))
    named = fx.set_label(spark, sf).select("set_no", v.alias("v"))
    return named.select("set_no", keys.client_lift(F.col("v")).alias("model_lift"), keys.display_lift(F.col("v")).alias("shown"))


FRAME_COLUMNS = "set_id, frame, round(confidence, 6) + 0.0 AS confidence, round(AU04_r, 6) + 0.0 AS AU04_r"


@query("success_filter__P8", with_steps({}, f"SELECT {FRAME_COLUMNS} FROM au_frame WHERE success = 1", "au_frame"))
def success_filter(spark, sf):
    frames = facial.detected_frames(fx.au_frame(spark, sf))
    return frames.select("set_id", "frame", r6(F.col("confidence")).alias("confidence"), r6(F.col("AU04_r")).alias("AU04_r"))


AU_MAX = [f"{a}_max" for a in AUS]
AU_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in AU_MAX)


@query(
    "au_max_columns__P9_P10",
    with_steps({}, f"SELECT video_name, {AU_ROUNDED} FROM face_full", "face_full"),
)
def au_max_columns(spark, sf):
    face = asm.drop_leakage(fx.face_full(spark, sf).withColumn("total_frames", F.lit(1)))
    picked = asm.columns_like(face, asm.AU_MAX)
    return face.select("video_name", *[r6(F.col(c)).alias(c) for c in picked])


@query(
    "stride_sampling__P14",
    with_steps({}, "SELECT set_id, pos, round(y, 6) + 0.0 AS y FROM frame_signal WHERE pos % greatest(1, CAST(round_even(fps / 12, 0) AS BIGINT)) = 0", "frame_signal"),
)
def stride_sampling(spark, sf):
    kept = signals.stride_frames(fx.frame_signal(spark, sf), F.col("fps"), F.lit(12.0))
    return kept.select("set_id", "pos", r6(F.col("y")).alias("y"))


@query(
    "observed_downsampling__P15",
    with_steps(
        {
            "steps": "SELECT set_id, timestamp - lag(timestamp) OVER (PARTITION BY set_id ORDER BY frame) AS dt FROM au_frame",
            "rate": "SELECT set_id, coalesce(1.0 / median(dt), 30.0) AS fps FROM steps GROUP BY set_id",
        },
        f"""SELECT {FRAME_COLUMNS} FROM (SELECT a.*, CASE WHEN fps > 7 THEN CAST(trunc(fps / 7) AS INT) ELSE 1 END AS every,
  row_number() OVER (PARTITION BY set_id ORDER BY frame) - 1 AS nth FROM au_frame a JOIN rate USING (set_id)) t WHERE nth % every = 0""",
        "au_frame",
    ),
)
def observed_downsampling(spark, sf):
    frames = fx.au_frame(spark, sf).select("set_id", "frame", "timestamp", "confidence", "AU04_r")
    kept = signals.observed_downsample(frames, 7.0)
    return kept.select("set_id", "frame", r6(F.col("confidence")).alias("confidence"), r6(F.col("AU04_r")).alias("AU04_r"))


@query(
    "trim_range__P16",
    with_steps(
        {
            "trims": """SELECT set_id, (set_id % 3) * 0.5 AS s, CASE WHEN set_id % 4 <> 1 THEN (set_id % 5) * 0.4 END AS e
  FROM (SELECT DISTINCT user_id AS set_id FROM events WHERE user_id % 2 = 0) u"""
        },
        """SELECT f.set_id, f.pos FROM frame_signal f LEFT JOIN trims t USING (set_id)
  WHERE NOT coalesce(s IS NOT NULL AND e IS NOT NULL AND e > s, false) OR pos / fps BETWEEN CAST(s AS DOUBLE) AND CAST(e AS DOUBLE)""",
        "frame_signal",
    ),
)
def trim_range(spark, sf):
    who = fx.table(spark, sf, "events").select(F.col("user_id").alias("set_id")).filter("set_id % 2 = 0").distinct()
    end = F.when(F.col("set_id") % 4 != 1, (F.col("set_id") % 5) * 0.4)
    trims = who.select("set_id", ((F.col("set_id") % 3) * 0.5).alias("start_s"), end.alias("end_s"))
    return signals.trim_range(fx.frame_signal(spark, sf), trims).select("set_id", "pos")


@query(
    "result_json__P19",
    with_steps(
        {},
        """SELECT video_name, CASE WHEN d_value < 1 THEN '{"level":"low"' ELSE '{"level":"high"' END || ',"name":"' || video_name || '"}' AS json
  FROM (SELECT video_name, round(d_value, 9) AS d_value FROM posture_full) t""",
        "posture_full",
    ),
)
def result_json(spark, sf):
    level = F.when(F.round("d_value", 9) < 1, "low").otherwise("high").alias("level")
    return fx.posture_full(spark, sf).select("video_name", F.to_json(F.struct(level, F.col("video_name").alias("name"))).alias("json"))


@query(
    "flattened_metadata__P20",
    with_steps({}, "SELECT video_name, round(d_value, 6) + 0.0 AS d_value, video_name AS metadata_video_name, 30 AS metadata_fps FROM posture_full", "posture_full"),
)
def flattened_metadata(spark, sf):
    nested = fx.posture_full(spark, sf).select(
        "video_name", r6(F.col("d_value")).alias("d_value"), F.struct("video_name", F.lit(30).alias("fps")).alias("metadata")
    )
    return asm.flatten_struct(nested, "metadata")


@query(
    "history_id__P22",
    with_steps({}, "SELECT id, concat(CAST(epoch(timestamp) AS BIGINT), '.000000_', video_name) AS record_id FROM history", "history"),
)
def history_id(spark, sf):
    past = fx.history(spark, sf)
    return past.select("id", keys.history_id(F.col("timestamp").cast("timestamp"), F.col("video_name")).alias("record_id"))


# --- facial summaries -------------------------------------------------------------------

FACE_STATS = ["detection_rate", "confidence_mean", "confidence_std", "confidence_min"]
DETECTION = {
    "face": f"""SELECT set_id, count(*) FILTER (WHERE success = 1) AS detection_count, count(*) AS total_frames,
  count(*) FILTER (WHERE success = 1) / CAST(count(*) AS DOUBLE) AS detection_rate,
  coalesce(avg(confidence) FILTER (WHERE success = 1), 0) AS confidence_mean,
  CASE WHEN count(*) FILTER (WHERE success = 1) > 0 THEN stddev_samp(confidence) FILTER (WHERE success = 1) ELSE 0 END AS confidence_std,
  coalesce(min(confidence) FILTER (WHERE success = 1), 0) AS confidence_min,
  {", ".join(f"max({a}_r) FILTER (WHERE success = 1) AS {a}_max" for a in AUS)},
  {" + ".join(f"CASE WHEN avg({a}_r) FILTER (WHERE success = 1) > 1.0 THEN 1 ELSE 0 END" for a in AUS)} AS au_highly_active_count
  FROM au_frame GROUP BY set_id"""
}
DETECTION_OUT = "detection_count, total_frames, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FACE_STATS)


def _face(spark, sf, **kw):
    return facial.facial_summary(fx.au_frame(spark, sf, frames=False), **kw)


@query("detection_features__F1", with_steps(DETECTION, f"SELECT set_id, {DETECTION_OUT} FROM face", "au_frame"))
def detection_features(spark, sf):
    out = fx.au_frame(spark, sf, frames=False).groupBy("set_id").agg(*facial.detection_columns())
    return out.select("set_id", "detection_count", "total_frames", *[r6(F.col(c)).alias(c) for c in FACE_STATS])


@query("au_maxima__F2_F8", with_steps(DETECTION, f"SELECT set_id, {AU_ROUNDED}, au_highly_active_count FROM face", "au_frame"))
def au_maxima(spark, sf):
    out = _face(spark, sf, with_error=False)
    return out.select("set_id", *[r6(F.col(c)).alias(c) for c in AU_MAX], "au_highly_active_count")


FACE_OUT = f"""set_id, CASE WHEN detection_count >= 400 THEN detection_count END AS detection_count,
  CASE WHEN detection_count >= 400 THEN round(confidence_mean, 6) + 0.0 END AS confidence_mean,
  CASE WHEN detection_count >= 400 THEN round(AU04_max, 6) + 0.0 END AS AU04_max,
  CASE WHEN detection_count < 400 THEN concat('Insufficient valid frames (', detection_count, ' detected).') END AS error"""


@query("minimum_frames__F12", with_steps(DETECTION, f"SELECT {FACE_OUT} FROM face", "au_frame"))
def minimum_frames(spark, sf):
    out = _face(spark, sf, min_valid=400)
    return out.select(
        "set_id", "detection_count", r6(F.col("confidence_mean")).alias("confidence_mean"), r6(F.col("AU04_max")).alias("AU04_max"), "error"
    )


UNITS = {
    "units": " UNION ALL ".join(f"SELECT set_id, '{a}' AS au, {a}_r AS value FROM au_frame WHERE success = 1" for a in AUS),
    "stats": """SELECT set_id, au, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, min(value) AS min,
  max(value) - min(value) AS range, avg(value * value) AS m2, avg(value * value * value) AS m3, kurtosis_pop(value) AS kurtosis,
  avg(CASE WHEN value > 0.5 THEN 1 ELSE 0 END) AS activation_ratio, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90 FROM units GROUP BY set_id, au""",
}
STAT_NAMES = ["mean", "std", "max", "min", "range", "median", "q25", "q75", "q90"]
_stat = ", ".join(grid_sql(f'"{c}"', f'"{c}"') for c in STAT_NAMES)


@query("au_statistics__F3", with_steps(UNITS, f"SELECT set_id, au, {_stat} FROM stats", "au_frame"))
def au_statistics(spark, sf):
    return _gridded(facial.unit_statistics(fx.au_frame(spark, sf, frames=False, dated=True)), STAT_NAMES, "set_id", "au")


@query(
    "au_shape__F4_F5_F6",
    with_steps(
        UNITS,
        """SELECT set_id, au, round((m3 - 3 * mean * m2 + 2 * mean * mean * mean) / (std * std * std), 5) + 0.0 AS skew, round(kurtosis, 5) + 0.0 AS kurtosis,
  round(activation_ratio, 6) + 0.0 AS activation_ratio, round(CASE WHEN q10 > 0.01 THEN q90 / q10 ELSE 0 END, 5) + 0.0 AS peak_baseline_ratio FROM stats""",
        "au_frame",
    ),
)
def au_shape(spark, sf):
    out = facial.unit_statistics(fx.au_frame(spark, sf, frames=False, dated=True))
    return out.select(
        "set_id",
        "au",
        r6(F.col("skew"), 5).alias("skew"),
        r6(F.col("kurtosis"), 5).alias("kurtosis"),
        r6(F.col("activation_ratio")).alias("activation_ratio"),
        r6(F.col("peak_baseline_ratio"), 5).alias("peak_baseline_ratio"),
    )


@query(
    "au_overall__F7",
    with_steps(
        UNITS,
        """SELECT set_id, round(avg(value), 6) + 0.0 AS au_overall_mean, round(max(value), 6) + 0.0 AS au_overall_max,
  round(stddev_pop(value), 6) + 0.0 AS au_overall_std FROM units GROUP BY set_id""",
        "au_frame",
    ),
)
def au_overall(spark, sf):
    out = facial.overall_units(facial.long_units(fx.au_frame(spark, sf, frames=False)))
    return out.select("set_id", *[r6(F.col(c)).alias(c) for c in ("au_overall_mean", "au_overall_max", "au_overall_std")])


def _strain_sql() -> dict[str, str]:
    def px(i):
        return f"p[{i * 2 % 64 + 1}]"

    def py(i):
        return f"p[{i * 2 % 64 + 2}]"

    def gap(i, j):
        return f"sqrt(pow({px(i)} - {px(j)}, 2) + pow({py(i)} - {py(j)}, 2))"

    def eye(e):
        return f"{gap(e['top'], e['bottom'])} / ({gap(e['outer'], e['inner'])} + 1e-6)"

    h = f"({gap(10, 152)} + 1e-6)"
    dot = f"({px(234)} - {px(152)}) * ({px(454)} - {px(152)}) + ({py(234)} - {py(152)}) * ({py(454)} - {py(152)})"
    return {
        "vec": "SELECT vec_id, floor(vec_id / 50) AS set_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS p FROM embeddings",
        "strain": f"""SELECT CAST(set_id AS BIGINT) AS set_id, vec_id, ({eye(facial.LEFT_EYE)} + {eye(facial.RIGHT_EYE)}) / 2 AS eye_aperture,
  ({gap(70, 159)} + {gap(300, 386)}) / 2 / {h} AS brow_lowering, {gap(13, 14)} / ({gap(61, 291)} + 1e-6) AS lip_compression,
  degrees(acos(greatest(-1, least(1, ({dot}) / ({gap(234, 152)} * {gap(454, 152)} + 1e-6))))) AS jaw_angle,
  ({py(0)} - ({py(61)} + {py(291)}) / 2) / {h} AS mouth_corner_stretch FROM vec""",
    }


STRAIN = ["eye_aperture", "brow_lowering", "lip_compression", "jaw_angle", "mouth_corner_stretch"]
_strain_cte = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _strain_sql().items())


def _strain(spark, sf):
    vecs = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")

    def point(i):
        return F.struct(
            F.element_at("embedding", i * 2 % 64 + 1).cast("double").alias("x"),
            F.element_at("embedding", i * 2 % 64 + 2).cast("double").alias("y"),
        )

    points = F.create_map(*[c for i in facial.MESH_POINTS for c in (F.lit(i), point(i))])
    mapped = vecs.select("vec_id", F.floor(F.col("vec_id") / 50).alias("set_id"), points.alias("points"))
    return mapped.select("set_id", "vec_id", *facial.strain_metrics(F.col("points"), by_number=True))


@query(
    "face_strain__G22",
    _strain_cte + " SELECT set_id, vec_id, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in STRAIN) + " FROM strain",
)
def face_strain(spark, sf):
    return _strain(spark, sf).select("set_id", "vec_id", *[r6(F.col(c), 4).alias(c) for c in STRAIN])


@query(
    "face_strain_summary__G23",
    _strain_cte
    + """ SELECT set_id, round(max(eye_aperture), 4) + 0.0 AS max_eye_aperture, round(avg(brow_lowering), 4) + 0.0 AS mean_brow_lowering,
  round(max(lip_compression), 4) + 0.0 AS max_lip_compression, round(max(jaw_angle), 4) + 0.0 AS max_jaw_angle,
  round(min(mouth_corner_stretch), 4) + 0.0 AS min_mouth_corner_stretch FROM strain GROUP BY set_id""",
)
def face_strain_summary(spark, sf):
    out = facial.strain_summary(_strain(spark, sf))
    return out.select("set_id", *[r6(F.col(c), 4).alias(c) for c in out.columns if c != "set_id"])


def _described_sql(c: str) -> str:
    return f"""SELECT set_id, '{c}' AS metric, count({c}) AS count, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std,
  round(min({c}), 4) + 0.0 AS min, round(max({c}), 4) + 0.0 AS max, round(quantile_cont({c}, 0.25), 4) + 0.0 AS p25,
  round(quantile_cont({c}, 0.5), 4) + 0.0 AS p50, round(quantile_cont({c}, 0.75), 4) + 0.0 AS p75 FROM strain GROUP BY set_id"""


@query("face_strain_describe__G23", _strain_cte + " " + " UNION ALL ".join(_described_sql(c) for c in STRAIN))
def face_strain_describe(spark, sf):
    frames = cut_lineage(_strain(spark, sf).withColumn("frame", F.col("vec_id") % 50), "strain")
    out = facial.describe_columns(frames, STRAIN)
    return out.select("set_id", "metric", "count", *[r6(F.col(c), 4).alias(c) for c in out.columns if c not in ("set_id", "metric", "count")])


# --- merges -------------------------------------------------------------------------------

STEM = r"coalesce(trim(regexp_replace(video_name, '([^./])\.[^./]*$', '\1')), '')"
MASTER = {
    "b": f"SELECT {STEM} AS set_id, * FROM bar_set",
    "f": f"SELECT {STEM} AS set_id, * EXCLUDE (video_name) FROM face_set",
    "p": f"SELECT {STEM} AS set_id, d_value FROM posture_set",
    "bf": "SELECT * FROM b FULL JOIN f USING (set_id)",
    "bfp": "SELECT * FROM bf FULL JOIN p USING (set_id)",
    "master": "SELECT bfp.* REPLACE (coalesce(video_name, concat(set_id, '.mp4')) AS video_name), l.rpe, l.set_no FROM bfp LEFT JOIN set_label l USING (set_id)",
    "extended": """SELECT *, (set_no % 7) / CAST(50 AS DOUBLE) AS confidence_std, (set_no % 11) / CAST(20 AS DOUBLE) AS confidence_min,
  set_no % 11 AS au_highly_active_count, CASE WHEN set_id LIKE 'Bench%' THEN 0 WHEN set_id LIKE 'Squat%' THEN 1 ELSE 2 END AS Lift_Type_Code FROM master""",
}
def full(steps: dict[str, str]) -> dict[str, str]:
    """The same steps over the views without gaps."""
    return {name: re.sub(r"\b(bar|face|posture)_set\b", r"\1_full", sql) for name, sql in steps.items()}


VIEWS = ("set_label", "bar_set", "face_set", "posture_set")
FULL_VIEWS = ("set_label", "bar_full", "face_full", "posture_full")


def _master(spark, sf) -> DataFrame:
    """With gaps, for the queries that are about gaps."""
    return asm.master_table(
        fx.bar_set(spark, sf), fx.face_set(spark, sf), fx.posture_set(spark, sf), fx.set_label(spark, sf).select("set_id", "rpe")
    )


FULL_SOURCES = (fx.bar_full, fx.face_full, fx.posture_full)


def _written(spark, sf) -> list:
    """The full sources, each written once, so that the disk holds the shuffles of one at a time; to be discarded after their use."""
    return [lambda *_, made=cut_lineage(source(spark, sf), "source"): made for source in FULL_SOURCES]


def _whole(spark, sf, bar=fx.bar_full, face=fx.face_full, post=fx.posture_full) -> DataFrame:
    return asm.master_table(bar(spark, sf), face(spark, sf), post(spark, sf), fx.set_label(spark, sf).select("set_id", "rpe"))


def _extended(spark, sf, *sources) -> DataFrame:
    no = F.regexp_extract("set_id", r"\d+$", 0).cast("bigint")
    return _whole(spark, sf, *sources).withColumns(
        {
            "confidence_std": (no % 7) / 50.0,
            "confidence_min": (no % 11) / 20.0,
            "au_highly_active_count": no % 11,
            "Lift_Type_Code": keys.lift_code(F.col("set_id")),
        }
    )


BAR_OUT = "rep_count, round(rep_change_s, 6) + 0.0 AS rep_change_s"
FACE_COLS = ["detection_rate", "confidence_mean", *AU_MAX]
_face_out = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FACE_COLS)


@query("bar_face_merge__J1", with_steps(MASTER, f"SELECT set_id, {BAR_OUT}, error, {_face_out} FROM bf", *VIEWS))
def bar_face_merge(spark, sf):
    out = asm.outer_merge(asm.keyed(fx.bar_set(spark, sf)), asm.keyed(fx.face_set(spark, sf)))
    return out.select("set_id", "rep_count", r6(F.col("rep_change_s")).alias("rep_change_s"), "error", *[r6(F.col(c)).alias(c) for c in FACE_COLS])


@query(
    "master_table__J2_J3_P12_P13",
    with_steps(MASTER, f"SELECT video_name, rpe, {BAR_OUT}, error, {_face_out}, round(d_value, 6) + 0.0 AS d_value FROM master", *VIEWS),
)
def master_table(spark, sf):
    wide = asm.ordered_columns(_master(spark, sf).drop("set_id"), asm.HEAD_COLUMNS)
    return wide.select(*[r6(F.col(c)).alias(c) if t == "double" and c != "rpe" else F.col(c) for c, t in wide.dtypes])


@query(
    "complete_rows__P11",
    with_steps(MASTER, "SELECT video_name, rpe FROM master WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["rpe", "rep_count", "rep_change_s", "d_value", *FACE_COLS]), *VIEWS),
)
def complete_rows(spark, sf):
    return asm.complete_rows(_master(spark, sf), "rpe").select("video_name", "rpe")


@query("coverage__F18", with_steps(MASTER, "SELECT count(*) AS sets, count(rpe) AS sets_with_rpe FROM master", *VIEWS))
def coverage(spark, sf):
    return asm.coverage(_master(spark, sf))


@query(
    "unprocessed_sets__J4",
    with_steps({}, "SELECT set_id AS video_name FROM set_label WHERE set_no % 5 = 0", "set_label"),
)
def unprocessed_sets(spark, sf):
    todo = fx.set_label(spark, sf).select(F.col("set_id").alias("video_name"))
    done = fx.set_label(spark, sf).filter("set_no % 5 <> 0").select(F.concat("set_id", F.lit(".MOV")).alias("video_name"))
    return asm.unprocessed(todo, done)


@query(
    "upsert__A10",
    with_steps({}, "SELECT video_name, CASE WHEN n % 2 = 0 THEN -1 ELSE rep_count END AS rep_count FROM (SELECT *, CAST(regexp_extract(video_name, '\\d+', 0) AS BIGINT) AS n FROM bar_full) t", "bar_full"),
)
def upsert(spark, sf):
    base = fx.bar_full(spark, sf).select("video_name", "rep_count")
    new = base.filter(keys.first_number(F.col("video_name")) % 2 == 0).select("video_name", F.lit(-1).cast("bigint").alias("rep_count"))
    path = fresh_path(spark, "master")
    asm.write_master(base, path, "video_name", 16)
    asm.upsert_master(spark, path, new, "video_name", 16)
    return asm.read_master(spark, path)


@query(
    "stacked_batches__A9_U1",
    with_steps(
        {},
        """SELECT video_name, rep_count, NULL AS d_value FROM bar_full
  UNION ALL SELECT video_name, NULL, round(d_value, 6) + 0.0 FROM posture_full""",
        "bar_full",
        "posture_full",
    ),
)
def stacked_batches(spark, sf):
    bar = fx.bar_full(spark, sf).select("video_name", "rep_count")
    post = fx.posture_full(spark, sf).select("video_name", r6(F.col("d_value")).alias("d_value"))
    paths = [fresh_path(spark, "batch") for _ in (bar, post)]
    for batch, path in zip((bar, post), paths):
        batch.write.option("header", True).csv(path)
    back = frames.read_batches(spark, paths)
    return back.select("video_name", F.col("rep_count").cast("long").alias("rep_count"), F.col("d_value").cast("double").alias("d_value"))


def _long_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT set_id, '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) + 0.0 AS value FROM {table}" for c in cols)


COMPARED = ["rep_count", "d_value", "detection_rate", "AU04_max"]
COMPARE = MASTER | {
    "want": f"SELECT * FROM ({_long_sql('b', COMPARED[:1])} UNION ALL {_long_sql('p', ['d_value'])}) t WHERE value IS NOT NULL",
    "got": f"SELECT * FROM ({_long_sql('b', COMPARED[:1])} UNION ALL {_long_sql('f', COMPARED[2:])}) t WHERE value IS NOT NULL",
}


def _compared(spark, sf):
    bar, face = asm.keyed(fx.bar_set(spark, sf)), asm.keyed(fx.face_set(spark, sf))
    post = asm.keyed(fx.posture_set(spark, sf))
    a = asm.long_features(bar, ["rep_count"])
    want = a.unionByName(asm.long_features(post, ["d_value"]))
    got = a.unionByName(asm.long_features(face, COMPARED[2:]))
    return want.filter("value IS NOT NULL"), got.filter("value IS NOT NULL")


@query(
    "feature_set_difference__U2",
    with_steps(
        COMPARE,
        """SELECT * FROM (SELECT set_id, feature, 'matched' AS verdict FROM (SELECT set_id, feature FROM want INTERSECT SELECT set_id, feature FROM got) a
  UNION ALL SELECT set_id, feature, 'missing' FROM (SELECT set_id, feature FROM want EXCEPT SELECT set_id, feature FROM got) b
  UNION ALL SELECT set_id, feature, 'extra' FROM (SELECT set_id, feature FROM got EXCEPT SELECT set_id, feature FROM want) c) t""",
        *VIEWS,
    ),
)
def feature_set_difference(spark, sf):
    sets = fx.table(spark, sf, "orders").count()
    return asm.compare_features(*_compared(spark, sf), rows=sets * (2 + len(COMPARED)))


@query(
    "matched_values__U2",
    with_steps(COMPARE, "SELECT set_id, feature, value FROM want INTERSECT SELECT set_id, feature, value FROM got", *VIEWS),
)
def matched_values(spark, sf):
    want, got = _compared(spark, sf)
    return want.intersect(got)


@query("distinct_names__U3", with_steps({}, "SELECT DISTINCT lift_type FROM history", "history"))
def distinct_names(spark, sf):
    return fx.history(spark, sf).select("lift_type").distinct()


# --- features ----------------------------------------------------------------------------

_all_aus = "[" + ", ".join(AU_MAX) + "]"
ENGINEERED = MASTER | {
    "au": f"SELECT *, list_filter({_all_aus}, lambda v: v IS NOT NULL) AS aus FROM extended",
    "agg": """SELECT *, coalesce(list_sum(aus), 0) AS AU_sum, list_avg(aus) AS AU_mean, list_max(aus) AS AU_max,
  list_aggregate(aus, 'stddev_samp') AS AU_std FROM au""",
    "feat": """SELECT *, AU04_max * AU07_max AS AU04_07_interaction, AU06_max * AU12_max AS AU06_12_interaction,
  AU09_max * AU10_max AS AU09_10_interaction, AU25_max * AU26_max AS AU25_26_interaction, AU04_max * AU06_max AS AU04_06_interaction,
  detection_rate * confidence_mean AS quality_score, confidence_std / (confidence_mean + 1e-6) AS confidence_cv,
  d_value * AU_sum AS body_face_strain, d_value * AU_mean AS d_value_x_AU_mean, d_value * au_highly_active_count AS d_value_x_active_AUs,
  rep_change_s / (rep_count + 1) AS avg_rep_duration, rep_change_s / (rep_count + 1) * AU_sum AS tempo_x_facial_strain,
  rep_change_s / (rep_count + 1) * d_value AS tempo_x_body_movement, rep_count * rep_count AS rep_count_sq,
  au_highly_active_count / (rep_count + 1) AS strain_per_rep, AU_sum / (rep_count + 1) AS AU_sum_per_rep,
  d_value / (rep_count + 1) AS d_value_per_rep, Lift_Type_Code * rep_count AS lift_type_x_reps FROM agg""",
}
FEATURES = features.MODEL_FEATURES


_feat_out = ", ".join(grid_sql(c, c) for c in FEATURES)


@query("engineered_features__E1_E6", with_steps(full(ENGINEERED), f"SELECT set_id, {_feat_out} FROM feat", *FULL_VIEWS))
def engineered_features(spark, sf):
    return _gridded(features.engineer(_extended(spark, sf)), FEATURES, "set_id")


@query(
    "aligned_features__J10",
    with_steps(
        full(MASTER),
        "SELECT set_id, " + ", ".join(f"coalesce(round({c}, 6) + 0.0, 0) AS {c}" for c in ["d_value", "AU04_max", "rep_change_s"]) + ", CAST(0 AS DOUBLE) AS unknown_feature FROM master",
        *FULL_VIEWS,
    ),
)
def aligned_features(spark, sf):
    wanted = ["d_value", "AU04_max", "unknown_feature", "rep_change_s"]
    return _rounded(asm.align_features(_whole(spark, sf), wanted), wanted, "set_id")


@query(
    "enhanced_features__E7",
    with_steps(
        full(MASTER),
        """SELECT set_id, round(rep_count / (rep_change_s + 1e-6), 3) + 0.0 AS rep_intensity, round(confidence_mean * confidence_mean, 6) + 0.0 AS confidence_mean_sq,
  round(detection_rate * detection_rate, 6) + 0.0 AS detection_rate_sq FROM master""",
        *FULL_VIEWS,
    ),
)
def enhanced_features(spark, sf):
    out = features.enhanced(_whole(spark, sf))
    return out.select("set_id", r6(F.col("rep_intensity"), 3).alias("rep_intensity"), *[r6(F.col(c)).alias(c) for c in ("confidence_mean_sq", "detection_rate_sq")])


@query(
    "three_factor_interactions__E8",
    with_steps(
        full(MASTER),
        """SELECT set_id, round(rep_change_s * AU04_max, 6) + 0.0 AS bar_x_strain, round(rep_change_s * d_value, 6) + 0.0 AS bar_x_rom,
  round(AU04_max * d_value, 6) + 0.0 AS strain_x_rom FROM master""",
        *FULL_VIEWS,
    ),
)
def three_factor_interactions(spark, sf):
    out = features.three_factor(_whole(spark, sf), "rep_change_s", "AU04_max", "d_value")
    return _rounded(out, ["bar_x_strain", "bar_x_rom", "strain_x_rom"], "set_id")


SERVING = MASTER | {
    "src": f"""SELECT e.*, b.set_id IS NOT NULL AS has_bar, f.set_id IS NOT NULL AS has_face, p.set_id IS NOT NULL AS has_posture,
  list_filter({_all_aus.replace("AU", "e.AU")}, lambda v: v IS NOT NULL) AS aus FROM extended e LEFT JOIN b USING (set_id) LEFT JOIN f USING (set_id) LEFT JOIN p USING (set_id)""",
    "s1": """SELECT set_id, has_bar AND has_face AS extraction_success, CASE WHEN has_bar THEN coalesce(rep_change_s, 0) ELSE 0 END AS rep_change_s,
  CASE WHEN has_bar AND rep_count > 0 THEN rep_count WHEN has_posture THEN 2 ELSE 0 END AS rep_count, has_posture,
  CASE WHEN has_face AND len(aus) > 0 THEN detection_rate ELSE 0.5 END AS detection_rate,
  CASE WHEN has_face AND len(aus) > 0 THEN confidence_mean ELSE 0.5 END AS confidence_mean,
  CASE WHEN has_face AND len(aus) > 0 THEN confidence_std ELSE 0.1 END AS confidence_std,
  CASE WHEN has_face AND len(aus) > 0 THEN len(list_filter(aus, lambda v: v > 2)) ELSE 0 END AS au_highly_active_count,
  CASE WHEN has_posture THEN d_value ELSE 0 END AS d_value, Lift_Type_Code,
  CASE WHEN has_face AND len(aus) > 0 THEN list_sum(aus) ELSE 0 END AS AU_sum, CASE WHEN has_face AND len(aus) > 0 THEN list_avg(aus) ELSE 0 END AS AU_mean,
  CASE WHEN has_face AND len(aus) > 0 THEN list_aggregate(aus, 'stddev_pop') ELSE 0 END AS AU_std FROM src""",
    "s2": """SELECT *, detection_rate * confidence_mean AS quality_score, confidence_std / (confidence_mean + 1e-6) AS confidence_cv,
  CASE WHEN has_posture THEN d_value * AU_sum END AS body_face_strain, CASE WHEN rep_count > 0 THEN rep_change_s / (rep_count + 1) END AS avg_rep_duration,
  CASE WHEN rep_count > 0 THEN (AU_sum + d_value) / (rep_count + 1) END AS strain_per_rep_serving,
  CASE WHEN rep_count > 0 THEN rep_change_s / (rep_count + 1) * AU_sum END AS tempo_x_facial_strain, Lift_Type_Code * rep_count AS lift_type_x_reps FROM s1""",
}
SERVED = [
    "rep_change_s", "detection_rate", "confidence_mean", "confidence_std", "d_value", "AU_sum", "AU_mean", "AU_std", "quality_score",
    "confidence_cv", "body_face_strain", "avg_rep_duration", "strain_per_rep_serving", "tempo_x_facial_strain",
]


def _serving(spark, sf, bar=fx.bar_set, face=fx.face_set, post=fx.posture_set) -> DataFrame:
    bar = asm.keyed(bar(spark, sf)).withColumn("_b", F.lit(True))
    face = asm.keyed(face(spark, sf)).withColumn("_f", F.lit(True))
    post = asm.keyed(post(spark, sf)).withColumn("_p", F.lit(True)).withColumn("posture_reps", F.lit(2))
    wide = asm.outer_merge(asm.outer_merge(bar, face), post)
    no = F.regexp_extract("set_id", r"\d+$", 0).cast("bigint")
    flagged = wide.withColumns(
        {
            "has_bar": F.coalesce("_b", F.lit(False)),
            "has_face": F.coalesce("_f", F.lit(False)),
            "has_posture": F.coalesce("_p", F.lit(False)),
            "confidence_std": (no % 7) / 50.0,
            "confidence_min": (no % 11) / 20.0,
            "movement": keys.movement_from_name(F.col("set_id")),
        }
    )
    return features.serving_features(flagged.drop("_b", "_f", "_p"))


@query(
    "serving_features__E9",
    with_steps(
        SERVING,
        "SELECT set_id, extraction_success, rep_count, au_highly_active_count, Lift_Type_Code, lift_type_x_reps, "
        + ", ".join(grid_sql(c, c) for c in SERVED)
        + " FROM s2",
        *VIEWS,
    ),
)
def serving_features(spark, sf):
    return _gridded(
        _serving(spark, sf), SERVED, "set_id", "extraction_success", "rep_count", "au_highly_active_count", "Lift_Type_Code", "lift_type_x_reps"
    )


LONG = full(ENGINEERED) | {"long": f"SELECT set_id, feature, value FROM ({_long_sql('feat', FEATURES)}) t"}


def _long(spark, sf):
    return asm.long_features(features.engineer(_extended(spark, sf)), FEATURES)


@query(
    "feature_groups__E10",
    with_steps(
        LONG,
        """SELECT CASE WHEN contains(feature, 'AU') AND contains(feature, '_max') THEN 'au_max'
  WHEN contains(feature, 'AU') OR contains(feature, 'interaction') OR contains(feature, '_x_') OR contains(feature, 'per_rep') OR contains(feature, 'quality')
    OR contains(feature, 'strain') OR contains(feature, 'tempo') OR feature LIKE '%\\_sq' ESCAPE '\\' THEN 'engineered' ELSE 'base' END AS grp,
  count(DISTINCT feature) AS n_features, count(value) AS n_values FROM long GROUP BY grp""",
        *FULL_VIEWS,
    ),
)
def feature_groups(spark, sf):
    per_feature = _long(spark, sf).groupBy("feature").agg(F.count("value").alias("n"))
    grouped = per_feature.groupBy(labels.feature_group(F.col("feature")).alias("grp"))
    return grouped.agg(F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("n_values"))


@query(
    "top_feature_sources__E10",
    with_steps(
        LONG
        | {"ranked": "SELECT feature, round(avg(abs(value)), 6) AS weight FROM long GROUP BY feature ORDER BY weight DESC, feature LIMIT 20"},
        """SELECT count(*) FILTER (WHERE contains(feature, 'AU') OR contains(feature, 'confidence') OR contains(feature, 'detection')) AS facial,
  count(*) FILTER (WHERE contains(feature, 'd_value') OR contains(feature, 'body')) AS body, count(*) FILTER (WHERE contains(feature, 'rep')) AS bar,
  count(*) FILTER (WHERE contains(feature, 'Lift_Type') OR contains(feature, 'lift_type')) AS lift FROM ranked""",
        *FULL_VIEWS,
    ),
)
def top_feature_sources(spark, sf):
    weights = _long(spark, sf).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("weight"))
    top = weights.orderBy(F.desc("weight"), "feature").limit(20)
    return top.agg(*[F.count(F.when(hit, F.lit(1))).alias(n) for n, hit in labels.feature_sources(F.col("feature")).items()])


SCALED = {"rep_change_s": 0.60, "AU04_max": 0.25, "d_value": 0.15}


@query(
    "weighted_min_max__E11",
    with_steps(
        full(MASTER) | {"train": "SELECT * FROM master WHERE set_no % 5 <> 1"},
        "SELECT set_id, "
        + ", ".join(
            f"round(({c} - (SELECT min({c}) FROM train)) / ((SELECT max({c}) FROM train) - (SELECT min({c}) FROM train)) * 10 * {w}, 6) + 0.0 AS {c}_scaled"
            for c, w in SCALED.items()
        )
        + " FROM master",
        *FULL_VIEWS,
    ),
)
def weighted_min_max(spark, sf):
    master = _whole(spark, sf)
    train = master.filter(F.regexp_extract("set_id", r"\d+$", 0).cast("bigint") % 5 != 1)
    return _rounded(features.min_max_weighted(master, train, SCALED), [f"{c}_scaled" for c in SCALED], "set_id")


@query(
    "standardized__E12",
    with_steps(
        full(MASTER) | {"train": "SELECT * FROM master WHERE set_no % 5 <> 1"},
        "SELECT set_id, "
        + ", ".join(f"round(({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) + 0.0 AS {c}_z" for c in SCALED)
        + " FROM master",
        *FULL_VIEWS,
    ),
)
def standardized(spark, sf):
    master = _whole(spark, sf)
    train = master.filter(F.regexp_extract("set_id", r"\d+$", 0).cast("bigint") % 5 != 1)
    return _rounded(features.standardize(master, train, list(SCALED)), [f"{c}_z" for c in SCALED], "set_id")


# --- imputation -----------------------------------------------------------------------------

FACE_VALUES = [*AU_MAX, "detection_rate", "confidence_mean"]
_means = ", ".join(f"avg({c}) AS {c}" for c in FACE_VALUES)
IMPUTE = {
    "lab": """SELECT concat(set_id, '.mp4') AS video_name, CASE lift WHEN 'Squat' THEN 'squat' WHEN 'Deadlift' THEN 'deadlift' ELSE 'bench_press' END AS ex, rpe
  FROM set_label WHERE set_no % 22 <> 11""",
    "face": """SELECT f.*, regexp_extract(video_name, '\\d+', 0)::BIGINT AS n FROM face_full f""",
    "sparse": "SELECT * REPLACE (CASE WHEN n % 11 <> 0 AND n % 70 < 69 THEN error ELSE 'failed' END AS error) FROM face",
    "donor": "SELECT * FROM sparse JOIN lab USING (video_name) WHERE error IS NULL",
    "g1": f"SELECT ex, rpe, count(*) AS c, {_means} FROM donor GROUP BY ex, rpe",
    "g2": f"SELECT rpe, count(*) AS c, {_means} FROM donor GROUP BY rpe",
    "g3": f"SELECT ex, count(*) AS c, {_means} FROM donor GROUP BY ex",
    "imputed": f"""SELECT s.video_name, s.error, l.ex, l.rpe, s.error IS NOT NULL AND (coalesce(g1.c, 0) >= 2 OR g2.c >= 1 OR g3.c >= 1) IS TRUE AS done,
  CASE WHEN g1.c >= 2 THEN g1.c WHEN g2.c >= 1 THEN g2.c WHEN g3.c >= 1 THEN g3.c END AS donors,
  CASE WHEN g1.c >= 2 THEN concat(l.ex, ' + RPE=', l.rpe) WHEN g2.c >= 1 THEN concat('RPE=', l.rpe, ' (any exercise)')
    WHEN g3.c >= 1 THEN concat(l.ex, ' (all RPE levels)') END AS how,
  {", ".join(f"CASE WHEN s.error IS NULL OR coalesce(g1.c, g2.c, g3.c) IS NULL THEN s.{c} WHEN g1.c >= 2 THEN g1.{c} WHEN g2.c >= 1 THEN g2.{c} ELSE g3.{c} END AS {c}" for c in FACE_VALUES)}
  FROM sparse s LEFT JOIN lab l USING (video_name) LEFT JOIN g1 ON g1.ex = l.ex AND g1.rpe = l.rpe LEFT JOIN g2 ON g2.rpe = l.rpe LEFT JOIN g3 ON g3.ex = l.ex""",
}


def _impute_inputs(spark, sf):
    n = keys.first_number(F.col("video_name"))
    failed = (n % 11 == 0) | (n % 70 >= 69)
    face = fx.face_full(spark, sf).withColumn("error", F.when(failed, F.lit("failed")).otherwise(F.col("error")))
    tags = fx.set_label(spark, sf).filter("set_no % 22 <> 11").select(
        keys.with_extension(F.col("set_id")).alias("video_name"), keys.exercise(F.col("set_id")).alias("exercise_type"), "rpe"
    )
    return face, tags


@query("failed_sets__I1", with_steps(IMPUTE, "SELECT video_name FROM sparse WHERE error IS NOT NULL", "set_label", "face_full"))
def failed_sets(spark, sf):
    return impute.failed_sets(_impute_inputs(spark, sf)[0]).select("video_name")


@query(
    "imputed_features__I2_J5",
    with_steps(
        IMPUTE,
        "SELECT video_name, CASE WHEN NOT done THEN error END AS error, done AS imputed, CASE WHEN done THEN how END AS imputation_method, "
        + ", ".join(grid_sql(c, c) for c in FACE_VALUES) + " FROM imputed",
        "set_label",
        "face_full",
    ),
)
def imputed_features(spark, sf):
    out = impute.impute_by_group_mean(*_impute_inputs(spark, sf))
    return _gridded(out, FACE_VALUES, "video_name", "error", "imputed", "imputation_method")


@query(
    "imputation_log__I3",
    with_steps(
        IMPUTE,
        "SELECT video_name, ex AS exercise, rpe, donors AS donor_count, 12 AS imputed_features, how AS imputation_method FROM imputed WHERE done",
        "set_label",
        "face_full",
    ),
)
def imputation_log(spark, sf):
    face, tags = _impute_inputs(spark, sf)
    return impute.imputation_log(impute.impute_by_group_mean(face, tags), len(asm.numeric_columns(face)))


@query(
    "imputation_summary__F11",
    with_steps(
        IMPUTE,
        """SELECT exercise, imputation_method, count(*) AS n, CAST(grouping(exercise, imputation_method) AS BIGINT) AS level
  FROM (SELECT ex AS exercise, how AS imputation_method FROM imputed WHERE done) t GROUP BY GROUPING SETS ((exercise), (imputation_method), ())""",
        "set_label",
        "face_full",
    ),
)
def imputation_summary(spark, sf):
    face, tags = _impute_inputs(spark, sf)
    return impute.imputation_summary(impute.imputation_log(impute.impute_by_group_mean(face, tags), 12))


# --- reports -----------------------------------------------------------------------------------


@query(
    "drift_by_exercise__F10",
    with_steps(
        {"t": "SELECT CASE WHEN video_name LIKE 'Bench%' THEN 'bench_press' WHEN video_name LIKE 'Squat%' THEN 'squat' ELSE 'deadlift' END AS exercise, d_value FROM posture_full"},
        """SELECT exercise, count(*) AS n, round(avg(d_value), 6) + 0.0 AS mean_d, round(min(d_value), 6) + 0.0 AS min_d, round(max(d_value), 6) + 0.0 AS max_d,
  round(stddev_samp(d_value), 6) + 0.0 AS std_d FROM t GROUP BY ROLLUP (exercise)""",
        "posture_full",
    ),
)
def drift_by_exercise(spark, sf):
    tagged = fx.posture_full(spark, sf).withColumn("exercise", keys.exercise(F.col("video_name")))
    return _rounded(reports.drift_summary(tagged), ["mean_d", "min_d", "max_d", "std_d"], "exercise", "n")


@query(
    "distinct_counts__F19",
    with_steps({}, "SELECT count(DISTINCT video_name) AS sets, count(DISTINCT lift_type) AS exercises FROM history", "history"),
)
def distinct_counts(spark, sf):
    return reports.distinct_counts(fx.history(spark, sf), {"sets": "video_name", "exercises": "lift_type"})


@query(
    "velocity_summary__F20",
    """SELECT round(avg(l_quantity), 6) + 0.0 AS bar_speed_mean, round(max(l_discount), 6) + 0.0 AS bar_speed_max,
  round(min(l_tax), 6) + 0.0 AS bar_speed_min, round(max(l_discount) - min(l_tax), 6) + 0.0 AS bar_speed_range FROM lineitem""",
)
def velocity_summary(spark, sf):
    from ..operators.reps import velocity_summary as summary

    lines = fx.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("avg_velocity"), F.col("l_discount").alias("peak_velocity"), F.col("l_tax").alias("min_velocity")
    )
    out = summary(lines)
    return _rounded(out, out.columns)


@query(
    "recent_history__R1",
    with_steps({}, "SELECT id, timestamp, lift_type, predicted_rpe FROM history ORDER BY timestamp DESC, id LIMIT 50", "history"),
)
def recent_history(spark, sf):
    out = reports.recent_history(fx.history(spark, sf), 0)
    return out.select("id", "timestamp", "lift_type", "predicted_rpe")


@query(
    "top_units__R2",
    with_steps(
        {
            "u": " UNION ALL ".join(f"SELECT video_name, '{a}' AS au, {a}_max AS v FROM face_full" for a in AUS),
            "r": "SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY v DESC, au) AS rn FROM u WHERE v IS NOT NULL",
        },
        "SELECT video_name, rn AS place, au, round(v, 6) + 0.0 AS value FROM r WHERE rn <= 3",
        "face_full",
    ),
)
def top_units(spark, sf):
    out = reports.top_units(fx.face_full(spark, sf), "video_name", [f"{a}_max" for a in AUS])
    return out.select("video_name", "place", "au", r6(F.col("value")).alias("value"))


@query(
    "sorted_results__R4",
    with_steps(
        {},
        """SELECT CASE WHEN video_name LIKE 'Bench%' THEN 'bench_press' WHEN video_name LIKE 'Squat%' THEN 'squat' ELSE 'deadlift' END AS exercise, video_name FROM posture_full""",
        "posture_full",
    ),
)
def sorted_results(spark, sf):
    tagged = fx.posture_full(spark, sf).withColumn("exercise", keys.exercise(F.col("video_name")))
    return tagged.orderBy("exercise", keys.first_number(F.col("video_name")), "video_name").select("exercise", "video_name")


@query(
    "status_bands__R5",
    with_steps(
        full(MASTER),
        """SELECT set_id, CASE WHEN rep_count IS NULL OR rep_count <= 0 THEN 'Unavailable' WHEN rep_change_s IS NULL THEN 'Detected'
  WHEN round(rep_change_s, 9) <= 0.2 THEN 'Stable Tempo' WHEN round(rep_change_s, 9) <= 0.45 THEN 'Mild Fatigue' ELSE 'High Fatigue' END AS bar_status,
  CASE WHEN d_value IS NULL THEN 'Unavailable' WHEN round(d_value, 9) < 0.8 THEN 'Stable Form' WHEN round(d_value, 9) < 1.4 THEN 'Form Drift' ELSE 'High Deviation' END AS posture_status,
  CASE WHEN detection_rate IS NULL AND confidence_mean IS NULL THEN 'No Face Data'
  WHEN coalesce(detection_rate, 0) >= 0.75 AND round(coalesce(confidence_mean, 0), 9) >= 0.7 THEN 'Strong Face Tracking'
  WHEN coalesce(detection_rate, 0) >= 0.5 AND round(coalesce(confidence_mean, 0), 9) >= 0.5 THEN 'Partial Face Tracking' ELSE 'Weak Face Tracking' END AS face_status FROM master""",
        *FULL_VIEWS,
    ),
)
def status_bands(spark, sf):
    clean = _whole(spark, sf).withColumns({c: F.round(c, 9) for c in ("rep_change_s", "d_value", "confidence_mean")})
    return clean.select(
        "set_id",
        labels.bar_status(F.col("rep_count"), F.col("rep_change_s")).alias("bar_status"),
        labels.posture_status(F.col("d_value")).alias("posture_status"),
        labels.face_status(F.col("detection_rate"), F.col("confidence_mean")).alias("face_status"),
    )


@query(
    "relative_dates__R6",
    with_steps(
        {"t": "SELECT *, (SELECT CAST(max(timestamp) AS DATE) FROM history) AS today FROM history"},
        """SELECT id, CASE date_diff('day', CAST(timestamp AS DATE), today) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday'
  ELSE strftime(timestamp, '%b %-d, %Y') END AS shown FROM t""",
        "history",
    ),
)
def relative_dates(spark, sf):
    past = fx.history(spark, sf)
    today = past.agg(F.max(F.to_date("timestamp")).alias("d")).first()["d"]
    return past.select("id", labels.relative_date(F.col("timestamp"), F.lit(today)).alias("shown"))


@query(
    "rpe_range__F15",
    with_steps({}, "SELECT min(rpe) AS min, max(rpe) AS max, round(avg(rpe), 6) + 0.0 AS mean, count(rpe) AS n FROM set_label", "set_label"),
)
def rpe_range(spark, sf):
    return _rounded(reports.target_range(fx.set_label(spark, sf), "rpe"), ["mean"], "min", "max", "n")


