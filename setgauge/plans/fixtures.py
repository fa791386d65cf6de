"""Views over the base tables that stand in for recorded sets.

Each view exists twice: as DataFrames built here, and as SQL text (``cte``)
for the side-by-side check. Row numbers go through ``tracks.number_rows``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracks

AUS = ["AU04", "AU06", "AU07", "AU09", "AU10", "AU12", "AU17", "AU20", "AU25", "AU26"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Frames per second of the recorded sets, by set_id modulo 4.
FRAME_RATES = (24.0, 30.0, 60.0, 30.0)


def frame_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    placed = tracks.number_rows(
        events.withColumnRenamed("user_id", "set_id"), ["set_id"], ["ts", "event_id"], F.date_trunc("DAY", "ts"), "pos"
    )
    return placed.select(
        "set_id",
        "pos",
        F.col("pos").cast("int").alias("frame_index"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("y"),
        F.element_at(F.array(*[F.lit(r) for r in FRAME_RATES]), (F.col("set_id") % 4 + 1).cast("int")).alias("fps"),
        (F.col("set_id") % 3).cast("int").alias("lift_code"),
    )


def au_values(of: Callable = lambda raw: raw, key: str = "l_orderkey") -> dict:
    """Intensities from columns of a line, or, with ``of`` the maximum, the largest ones: none falls where its column rises.

    ``key`` is what the lines are grouped by: one value for all of them.
    """

    def scaled(name, factor, by):
        raw = (F.col(key if name == "l_orderkey" else name) * factor) % 500
        return ((raw if name == "l_orderkey" else of(raw)) / by).cast("double")

    return {
        "AU04": (of(F.col("l_quantity")) / 10.0).cast("double"),
        "AU06": (of(F.col("l_discount")) * 50).cast("double"),
        "AU07": (of(F.col("l_tax")) * 60).cast("double"),
        "AU09": scaled("l_partkey", 1, 100.0),
        "AU10": scaled("l_orderkey", 1, 100.0),
        "AU12": (of(F.col("l_linenumber") % 6) * 0.45).cast("double"),
        "AU17": scaled("l_partkey", 7, 300.0),
        "AU20": scaled("l_orderkey", 3, 400.0),
        "AU25": scaled("l_orderkey", 11, 100.0),
        "AU26": scaled("l_partkey", 13, 100.0),
    }


def success() -> "F.Column":
    return F.when(F.col("l_returnflag") == "R", 0).otherwise(1)


def au_frame(spark: SparkSession, sf_dir: str, frames: bool = True, dated: bool = False) -> DataFrame:
    """``frames=False`` leaves out the frame numbers for order-free work; with ``dated`` the rows are those that have numbers."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "set_id")
    if dated:
        lines = lines.filter("set_id IS NOT NULL AND l_shipdate IS NOT NULL")
    if frames:
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
        lines = tracks.number_rows(lines, ["set_id"], order, F.date_trunc("DAY", "l_shipdate"), "frame")
    numbered = ["frame", (F.col("frame") / 30.0).cast("double").alias("timestamp")] if frames else []
    return lines.select(
        "set_id",
        *numbered,
        success().alias("success"),
        (1.0 - F.col("l_discount") * 5).cast("double").alias("confidence"),
        *[v.alias(f"{au}_r") for au, v in au_values().items()],
    )


def pose_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = vecs.select(
        "vec_id",
        "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("person"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("joint"))
    at = F.col("person") * 32 + F.col("joint") * 2
    group = F.floor(F.col("vec_id") / 50)
    raw = cells.select(
        group.cast("int").alias("set_id"),
        (F.col("vec_id") % 50).cast("int").alias("frame_index"),
        "person",
        "joint",
        F.element_at("embedding", (at + 1).cast("int")).cast("double").alias("x"),
        F.element_at("embedding", (at + 2).cast("int")).cast("double").alias("y"),
        ((group % 2 == 1) & ((F.col("vec_id") * 7 + F.col("joint") * 3 + F.col("person")) % 97 == 0)).alias("gap"),
    )
    return raw.select(
        "set_id",
        "frame_index",
        "person",
        "joint",
        F.least(F.lit(1.0), F.abs("x") * 4).alias("score"),
        F.when(~F.col("gap"), F.col("x")).alias("x"),
        F.when(~F.col("gap"), F.col("y")).alias("y"),
    )


def _lift(no) -> "F.Column":
    return F.when(no % 3 == 0, "Bench Press").when(no % 3 == 1, "Squat").otherwise("Deadlift")


def _set_name(no) -> "F.Column":
    return F.concat_ws(" ", _lift(no), no.cast("string"))


def set_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("set_no")
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("set_no"), "o_custkey")
        .select(
            "set_no",
            _lift(no).alias("lift"),
            _set_name(no).alias("set_id"),
            (1 + (F.col("o_custkey") % 19) / 2.0).cast("double").alias("rpe"),
        )
    )


def _lines_of_sets(spark: SparkSession, sf_dir: str, columns: list, keep, *totals) -> DataFrame:
    """``totals`` over the lines of each labelled set, with its number of labels: added up by the lines' own key, so that one
    shuffle carries sums, not lines, and no line is copied to its labels."""
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_no")).filter(keep).groupBy("set_no").agg(F.count(F.lit(1)).alias("_labels"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_no"), *columns).filter(keep)
    summed = lines.filter("set_no IS NOT NULL").groupBy("set_no").agg(*totals)
    return summed.join(labels, "set_no").withColumn("set_id", _set_name(F.col("set_no")))


def bar_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every set."""
    return bar_set(spark, sf_dir, "true")


def bar_set(spark: SparkSession, sf_dir: str, where: str = "set_no % 5 <> 0") -> DataFrame:
    spread = (F.max("l_quantity") - F.min("l_quantity")) / 10
    sets = _lines_of_sets(spark, sf_dir, ["l_quantity"], where, F.count(F.lit(1)).alias("_lines"), spread.alias("rep_change_s"))
    return sets.select(F.concat("set_id", F.lit(".mp4")).alias("video_name"), (F.col("_lines") * F.col("_labels")).alias("rep_count"), "rep_change_s")


def face_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every set."""
    return face_set(spark, sf_dir, "true")


def face_set(spark: SparkSession, sf_dir: str, where: str = "set_no % 4 <> 3") -> DataFrame:
    ok = F.col("set_no") % 11 != 0
    used = ["l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    stats = _lines_of_sets(
        spark,
        sf_dir,
        used,
        where,
        F.avg(success().cast("double")).alias("detection_rate"),
        F.avg(1.0 - F.col("l_discount") * 5).alias("confidence_mean"),
        *[v.alias(f"{au}_max") for au, v in au_values(F.max, "set_no").items()],
    )
    return stats.select(
        F.concat("set_id", F.lit(".mp4")).alias("video_name"),
        F.when(~ok, F.lit("Insufficient valid frames")).alias("error"),
        *[F.when(ok, F.col(c)).alias(c) for c in ["detection_rate", "confidence_mean", *[f"{a}_max" for a in AUS]]],
    )


def posture_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every set."""
    return posture_set(spark, sf_dir, "true")


def posture_set(spark: SparkSession, sf_dir: str, where: str = "set_no % 7 <> 0") -> DataFrame:
    sets = _lines_of_sets(spark, sf_dir, ["l_discount"], where, (F.avg("l_discount") * 20).alias("d_value"))
    return sets.select(F.col("set_id").alias("video_name"), "d_value")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    lift = (
        F.when(F.col("o_orderkey") % 3 == 0, "Bench Press").when(F.col("o_orderkey") % 3 == 1, "Squat").otherwise("Deadlift")
    )
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("timestamp"),
        lift.alias("lift_type"),
        (1 + (F.col("o_custkey") % 19) / 2.0).cast("double").alias("predicted_rpe"),
        ((F.col("o_custkey") % 100) / 100.0).cast("double").alias("confidence"),
        F.concat(lift, F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("video_name"),
    )


def set_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("set_no")

    def text(c):
        return c.cast("string")

    parts = (
        F.when(F.col("k") == 0, F.lit(" RESULT"))
        .when(F.col("k") == 1, F.concat(F.lit(" First rep: ("), text(no % 90), F.lit(", "), text(no % 90 + 40), F.lit(")")))
        .when(F.col("k") == 2, F.concat(F.lit(" Last rep : ("), text(no % 90 + 200), F.lit(", "), text(no % 90 + 250), F.lit(")")))
        .otherwise(F.concat(F.lit(" D value  : "), text(no % 3), F.lit("."), F.lpad(text(no % 997), 4, "0")))
    )
    return (
        set_label(spark, sf_dir)
        .select("set_no", "set_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        .filter("NOT (set_no % 13 = 0 AND k = 3)")
        .select((no * 10 + F.col("k")).alias("line_no"), F.concat("set_id", parts).alias("line"))
    )


# --- the same views as SQL ---------------------------------------------------

_PER_LINE = {
    "AU04": "CAST(l_quantity/10.0 AS DOUBLE)",
    "AU06": "CAST(l_discount*50 AS DOUBLE)",
    "AU07": "CAST(l_tax*60 AS DOUBLE)",
    "AU09": "CAST((l_partkey%500)/100.0 AS DOUBLE)",
    "AU10": "CAST((l_orderkey%500)/100.0 AS DOUBLE)",
    "AU12": "CAST((l_linenumber%6)*0.45 AS DOUBLE)",
    "AU17": "CAST((l_partkey*7%500)/300.0 AS DOUBLE)",
    "AU20": "CAST((l_orderkey*3%500)/400.0 AS DOUBLE)",
    "AU25": "CAST((l_orderkey*11%500)/100.0 AS DOUBLE)",
    "AU26": "CAST((l_partkey*13%500)/100.0 AS DOUBLE)",
}

VIEWS = {
    "frame_signal": """
SELECT user_id AS set_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_index,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS y,
  CAST(list_extract([24.0, 30.0, 60.0, 30.0], CAST(user_id % 4 + 1 AS INT)) AS DOUBLE) AS fps, CAST(user_id % 3 AS INT) AS lift_code
FROM events""",
    "au_frame": f"""
SELECT l_suppkey AS set_id, frame, CAST(frame / 30.0 AS DOUBLE) AS timestamp,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS success,
  CAST(1.0 - l_discount * 5 AS DOUBLE) AS confidence,
  {", ".join(f"{e} AS {a}_r" for a, e in _PER_LINE.items())}
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame FROM lineitem) t""",
    "pose_joint": """
SELECT set_id, frame_index, person, joint, score,
  CASE WHEN gap THEN NULL ELSE x END AS x, CASE WHEN gap THEN NULL ELSE y END AS y
FROM (SELECT CAST(floor(vec_id / 50) AS INT) AS set_id, CAST(vec_id % 50 AS INT) AS frame_index,
  CAST(person AS INT) AS person, CAST(joint AS INT) AS joint,
  CAST(list_extract(embedding, CAST(person*32 + joint*2 + 1 AS INT)) AS DOUBLE) AS x,
  CAST(list_extract(embedding, CAST(person*32 + joint*2 + 2 AS INT)) AS DOUBLE) AS y,
  least(CAST(1.0 AS DOUBLE), abs(CAST(list_extract(embedding, CAST(person*32 + joint*2 + 1 AS INT)) AS DOUBLE)) * 4) AS score,
  (floor(vec_id / 50) % 2 = 1 AND (vec_id*7 + joint*3 + person) % 97 = 0) AS gap
  FROM embeddings, range(2) a(person), range(16) b(joint)) t""",
    "set_label": """
SELECT o_orderkey AS set_no, lift, concat(lift, ' ', CAST(o_orderkey AS VARCHAR)) AS set_id,
  CAST(1 + (o_custkey % 19) / 2.0 AS DOUBLE) AS rpe
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'Bench Press' WHEN 1 THEN 'Squat' ELSE 'Deadlift' END AS lift FROM orders) t""",
    "bar_set": """
SELECT concat(s.set_id, '.mp4') AS video_name, count(*) AS rep_count,
  (max(l_quantity) - min(l_quantity)) / 10 AS rep_change_s
FROM set_label s JOIN lineitem l ON l.l_orderkey = s.set_no WHERE s.set_no % 5 <> 0 GROUP BY s.set_id""",
    "face_set": f"""
SELECT concat(s.set_id, '.mp4') AS video_name,
  CASE WHEN s.set_no % 11 = 0 THEN 'Insufficient valid frames' END AS error,
  CASE WHEN s.set_no % 11 <> 0 THEN avg(CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS DOUBLE)) END AS detection_rate,
  CASE WHEN s.set_no % 11 <> 0 THEN avg(1.0 - l_discount * 5) END AS confidence_mean,
  {", ".join(f"CASE WHEN s.set_no % 11 <> 0 THEN max({e}) END AS {a}_max" for a, e in _PER_LINE.items())}
FROM set_label s JOIN lineitem l ON l.l_orderkey = s.set_no WHERE s.set_no % 4 <> 3 GROUP BY s.set_id, s.set_no""",
    "posture_set": """
SELECT s.set_id AS video_name, avg(l_discount) * 20 AS d_value
FROM set_label s JOIN lineitem l ON l.l_orderkey = s.set_no WHERE s.set_no % 7 <> 0 GROUP BY s.set_id""",
    "history": """
SELECT o_orderkey AS id, o_orderdate AS timestamp, lift AS lift_type, rpe AS predicted_rpe,
  CAST((o_custkey % 100) / 100.0 AS DOUBLE) AS confidence, concat(set_id, '.mp4') AS video_name
FROM orders JOIN set_label ON set_no = o_orderkey""",
    "set_log": """
SELECT set_no * 10 + k AS line_no, concat(set_id, CASE k WHEN 0 THEN ' RESULT'
  WHEN 1 THEN concat(' First rep: (', CAST(set_no % 90 AS VARCHAR), ', ', CAST(set_no % 90 + 40 AS VARCHAR), ')')
  WHEN 2 THEN concat(' Last rep : (', CAST(set_no % 90 + 200 AS VARCHAR), ', ', CAST(set_no % 90 + 250 AS VARCHAR), ')')
  ELSE concat(' D value  : ', CAST(set_no % 3 AS VARCHAR), '.', lpad(CAST(set_no % 997 AS VARCHAR), 4, '0')) END) AS line
FROM set_label, range(4) a(k) WHERE NOT (set_no % 13 = 0 AND k = 3)""",
}

# the sources leave out different sets, which is what merges are for; the full views hold every set
for _name in ("bar", "face", "posture"):
    VIEWS[f"{_name}_full"] = re.sub(r" WHERE s\.set_no % \d <> \d", "", VIEWS[f"{_name}_set"])

_NEEDS_LABEL = {"bar_set", "face_set", "posture_set", "bar_full", "face_full", "posture_full", "history", "set_log"}


def cte(*views: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause defining the views a check needs, then ``extra`` steps."""
    names = list(views)
    if _NEEDS_LABEL & set(names) and "set_label" not in names:
        names.insert(0, "set_label")
    names.sort(key=lambda n: n in _NEEDS_LABEL)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
