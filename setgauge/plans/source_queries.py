"""Readers and sinks, exercised on files Spark writes from the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded as r6
from ..operators import facial
from ..session import fresh_path
from ..sources import frames as fr
from ..sources import logs, tables
from . import fixtures as fx
from .fixtures import AUS, cte
from .registry import query
from .set_queries import AU_MAX, DETECTION, with_steps


def _au_files(spark, sf) -> str:
    """AU frames as CSV with blank-padded headers: columns in two orders, and a third of the sets without ``success``."""
    frames = fx.au_frame(spark, sf).withColumnRenamed("set_id", "face_id")
    path = fresh_path(spark, "au_csv")
    for kind, names in enumerate((frames.columns, frames.columns[::-1], [c for c in frames.columns if c != "success"])):
        own = frames.filter(F.col("face_id") % 3 == kind).select(*[F.col(c).alias(f" {c}") for c in names])
        own.write.mode("append").option("header", True).csv(f"{path}/kind={kind}")
    return path


FILED = {"filed": "SELECT * REPLACE (CASE WHEN set_id % 3 = 2 THEN 1 ELSE success END AS success) FROM au_frame"}


@query(
    "au_frame_reader__A1",
    with_steps(
        FILED,
        "SELECT CAST(set_id AS BIGINT) AS set_id, frame, CAST(success AS BIGINT) AS success, round(confidence, 6) + 0.0 AS confidence, "
        "round(timestamp, 6) + 0.0 AS timestamp, " + ", ".join(f"round({a}_r, 6) + 0.0 AS {a}_r" for a in AUS) + " FROM filed",
        "au_frame",
    ),
)
def au_frame_reader(spark, sf):
    read = fr.read_au_frames(spark, _au_files(spark, sf), set_id=F.col("face_id"))
    return read.select("set_id", "frame", "success", *[r6(F.col(c)).alias(c) for c in ["confidence", "timestamp", *facial.INTENSITY]])


@query(
    "rebuilt_face_features__A8",
    with_steps(
        FILED | {"face": DETECTION["face"].replace("FROM au_frame", "FROM filed")},
        """SELECT concat(set_id, '.mp4') AS video_name, CASE WHEN detection_count >= 400 THEN total_frames END AS total_frames,
  CASE WHEN detection_count < 400 THEN concat('Insufficient valid frames (', detection_count, ' detected).') END AS error, """
        + ", ".join(f"CASE WHEN detection_count >= 400 THEN round({c}, 6) + 0.0 END AS {c}" for c in AU_MAX)
        + " FROM face",
        "au_frame",
    ),
)
def rebuilt_face_features(spark, sf):
    out = fr.rebuild_facial_features(spark, _au_files(spark, sf), 400, F.col("face_id"))
    return out.select("video_name", "total_frames", "error", *[r6(F.col(c)).alias(c) for c in AU_MAX])


KEYPOINTS = """SELECT set_id, frame_index, joint,
  CASE WHEN frame_index % 11 <> 5 THEN round(x, 6) + 0.0 END AS x, CASE WHEN frame_index % 11 <> 5 THEN round(y, 6) + 0.0 END AS y
  FROM pose_joint WHERE person = 0"""


@query("keypoint_reader__A2", cte("pose_joint") + KEYPOINTS)
def keypoint_reader(spark, sf):
    from ..operators import posture

    packed = posture.pose_frames(posture.first_person(fx.pose_joint(spark, sf)))
    pairs = F.zip_with("x", "y", lambda a, b: F.array(F.coalesce(a, F.lit(float("nan"))), F.coalesce(b, F.lit(float("nan")))))
    people = F.when(F.col("frame_index") % 11 == 5, F.slice(F.array(F.struct(pairs.alias("keypoints"))), 1, 0)).otherwise(
        F.array(F.struct(pairs.alias("keypoints")))
    )
    path = fresh_path(spark, "keypoints")
    # a line names its set, so there are as many files as tasks, not as sets times tasks
    packed.select("set_id", "frame_index", people.alias("people")).write.json(path)
    rows = fr.read_keypoint_lines(spark, path, packed.schema["set_id"].dataType)
    return rows.select("set_id", "frame_index", "joint", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("keypoint_arrays__A2", cte("pose_joint") + KEYPOINTS)
def keypoint_arrays(spark, sf):
    """One array per file and set, written line by line, so that no set is held in a row."""
    from ..operators import posture

    packed = posture.pose_frames(posture.first_person(fx.pose_joint(spark, sf)))
    pairs = F.zip_with("x", "y", lambda a, b: F.array(F.coalesce(a, F.lit(float("nan"))), F.coalesce(b, F.lit(float("nan")))))
    people = F.when(F.col("frame_index") % 11 == 5, F.lit("[]")).otherwise(F.regexp_replace(F.to_json(F.array(F.struct(pairs.alias("keypoints")))), '"NaN"', "NaN"))
    frame = F.concat(F.lit('  {"frame_index": '), F.col("frame_index").cast("string"), F.lit(',\n    "people": '), people, F.lit("\n  }"))
    last = packed.groupBy("set_id").agg(F.max("frame_index").alias("last"))
    lines = packed.join(last, "set_id").select("set_id", F.col("frame_index").alias("at"), F.concat(frame, F.when(F.col("frame_index") < F.col("last"), ",").otherwise("\n]")).alias("value"))
    lines = lines.union(last.select("set_id", F.lit(-1), F.lit("[")))
    path = fresh_path(spark, "keypoint_arrays")
    lines.repartition("set_id").sortWithinPartitions("set_id", "at").select("set_id", "value").write.partitionBy("set_id").text(path)
    rows = fr.read_keypoint_arrays(spark, path, set_id=F.col("set_id"))
    return rows.select("set_id", "frame_index", "joint", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(
    "posture_log_parser__A3",
    cte("set_log", extra={"r": "SELECT DISTINCT set_no, set_id FROM set_label WHERE set_no % 13 <> 0"})
    + """ SELECT set_id AS video_name, CAST(set_no % 90 AS INT) AS first_rep_start, CAST(set_no % 90 + 40 AS INT) AS first_rep_end,
  CAST(set_no % 90 + 200 AS INT) AS last_rep_start, CAST(set_no % 90 + 250 AS INT) AS last_rep_end,
  CAST(concat(set_no % 3, '.', lpad(CAST(set_no % 997 AS VARCHAR), 4, '0')) AS DOUBLE) AS d_value FROM r""",
)
def posture_log_parser(spark, sf):
    path = fresh_path(spark, "posture_logs")
    lines = fx.set_log(spark, sf).withColumn("log", F.pmod(F.floor(F.col("line_no") / 10), F.lit(16)))
    in_order = lines.repartition("log").sortWithinPartitions("log", "line_no")
    in_order.select("log", "line").write.partitionBy("log").text(path)
    parsed = logs.parse_posture_log(logs.read_log_lines(spark, path), F.lit("any"))
    return parsed.drop("exercise")


@query(
    "rep_report_reader__A4",
    cte("bar_full")
    + """ SELECT replace(video_name, '.mp4', '') AS video_name, 'TBT' AS pattern, CAST(rep_count AS INT) AS rep_count,
  round(rep_change_s + rep_count / CAST(100 AS DOUBLE), 2) AS longest_s FROM bar_full""",
)
def rep_report_reader(spark, sf):
    bars = fx.bar_full(spark, sf).withColumn("set_id", F.replace("video_name", F.lit(".mp4")))
    one = bars.select(
        "set_id",
        F.explode(F.sequence(F.lit(1), F.col("rep_count").cast("int"))).alias("rep_no"),
        "rep_change_s",
        F.lit("TBT").alias("pattern"),
        F.lit("Squat").alias("movement"),
    )
    one = one.withColumn("duration_s", F.col("rep_change_s") + F.col("rep_no") / 100).drop("rep_change_s")
    path = fresh_path(spark, "rep_reports")
    logs.write_rep_reports(logs.rep_report_text(one), path)  # a file per set would be a listing and a task share per set
    return logs.read_rep_reports(spark, path, logs.REPORT_END).select(
        "video_name", "pattern", F.size("durations_s").alias("rep_count"), F.round(F.array_max("durations_s"), 2).alias("longest_s")
    )


@query(
    "label_reader__A5",
    cte("set_label")
    + """ SELECT concat(set_id, '.mp4') AS video_name, CASE lift WHEN 'Squat' THEN 'squat' WHEN 'Deadlift' THEN 'deadlift' ELSE 'bench_press' END AS exercise_type, rpe FROM set_label""",
)
def label_reader(spark, sf):
    path = fresh_path(spark, "labels")
    labels = fx.set_label(spark, sf).select(F.col("set_id").alias("Set"), F.col("rpe").alias("RPE"))
    labels.write.option("header", True).csv(path)
    return tables.read_labels(spark, path)


@query(
    "input_listing__A7",
    cte("set_label")
    + """ SELECT bucket, count(*) AS n_sets, count(DISTINCT bucket) AS n_files, true AS has_length FROM (SELECT set_no % 5 AS bucket FROM set_label) GROUP BY bucket""",
)
def input_listing(spark, sf):
    """Files written from a table, listed by extension, and the listing joined to what they hold."""
    path = fresh_path(spark, "inputs")
    rows = fx.set_label(spark, sf).withColumn("bucket", F.col("set_no") % 5)
    rows.repartition("bucket").write.partitionBy("bucket").option("header", True).csv(path)
    rows.drop("bucket").limit(1).write.mode("append").json(f"{path}/bucket=0")  # another extension
    listed = fr.list_inputs(spark, path, [".CSV"]).withColumn("bucket", F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long"))
    files = listed.groupBy("bucket").agg(F.count("*").alias("n_files"), F.min(F.col("length") > 0).alias("has_length"))
    held = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n_sets"))
    return held.join(files, "bucket").select("bucket", "n_sets", "n_files", "has_length")


@query(
    "history_reader__A12",
    cte("history") + " SELECT CAST(id AS VARCHAR) AS id, timestamp, lift_type, predicted_rpe, confidence, video_name FROM history",
)
def history_reader(spark, sf):
    path = fresh_path(spark, "history")
    past = fx.history(spark, sf)
    half = F.col("id") % 2
    tables.append_history(past.filter(half == 0), path)
    arrays = fresh_path(spark, "history_arrays")  # the other half as files that each hold one array
    stamp = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    record = F.struct(*[(stamp if f.name == "timestamp" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in tables.HISTORY])
    files = past.filter(half == 1).groupBy(F.pmod(F.hash("id"), F.lit(16)).alias("file")).agg(F.to_json(F.collect_list(record)).alias("value"))
    files.repartition("file").write.partitionBy("file").text(arrays)
    back = tables.read_history_lines(spark, path).unionByName(tables.read_history(spark, arrays).drop("file"))
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "saved_tables__A11",
    cte("posture_full") + " SELECT video_name, round(d_value, 6) + 0.0 AS d_value, round(d_value, 6) + 0.0 AS d_csv, round(d_value, 6) + 0.0 AS d_json FROM posture_full",
)
def saved_tables(spark, sf):
    """The same table saved in each form and read back."""
    rows, back = fx.posture_full(spark, sf), []
    for form, name in (("parquet", "d_value"), ("csv", "d_csv"), ("json", "d_json")):
        path = fresh_path(spark, f"posture_{form}")
        tables.save_table(rows, path, form)
        read = spark.read.schema(rows.schema).option("header", True).format(form).load(path)
        back.append(read.select("video_name", r6(F.col("d_value")).alias(name)))
    return back[0].join(back[1], "video_name").join(back[2], "video_name")
