"""Readers for per-frame files: AU tables, keypoint JSON, file listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assemble import stack_tables
from ..operators.facial import MINIMAL_COLUMNS, detected_frames, facial_summary
from ..operators.posture import JOINTS
from ..operators.signals import observed_downsample

WHOLE_NUMBERS = {"frame", "face_id", "success"}

KEYPOINT_FRAMES = T.StructType(
    [
        T.StructField("frame_index", T.IntegerType()),
        T.StructField(
            "people",
            T.ArrayType(T.StructType([T.StructField("keypoints", T.ArrayType(T.ArrayType(T.DoubleType())))])),
        ),
    ]
)


def stem_of_path(path: Column, suffix: str = "") -> Column:
    """File stem of a path, decoded, without a known suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "")
    return F.regexp_replace(stem, f"{suffix}$", "") if suffix else stem


def au_headers(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Files by header line. The driver holds one path per file, as it does for any file scan."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.filter(F.col("value").rlike(r"(^|,)\s*(frame|timestamp|confidence|success|AU\d\d_[rc])\s*(,|$)"))
    found = heads.groupBy("value").agg(F.collect_set("file").alias("files")).collect()
    return {r["value"]: sorted(unquote(f) for f in r["files"]) for r in found}


def read_au_frames(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = MINIMAL_COLUMNS,
    suffix: str = "_pose_guided",
    set_id: Column | None = None,
    only_success: bool = False,
    sample_fps: float | None = None,
) -> DataFrame:
    """AU frame CSVs of any number of sets, pruned to ``columns``.

    Files may differ in the order and choice of their columns, and headers may be padded with blanks:
    files are grouped by header, each group is parsed by its own names, and the groups are united by
    name (a column that a file lacks is null; a file without ``success`` has valid frames only).
    ``set_id`` overrides how the set is read from ``_metadata.file_path`` (default: file stem).
    ``only_success`` keeps valid frames; ``sample_fps`` thins each set to about that rate by its observed one.
    """
    parts = []
    for header, files in au_headers(spark, path).items():
        names = [c.strip() for c in header.split(",")]
        schema = T.StructType([T.StructField(n, T.LongType() if n in WHOLE_NUMBERS else T.DoubleType()) for n in names])
        frames = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .csv(files)
        )
        key = stem_of_path(F.col("_metadata.file_path"), suffix) if set_id is None else set_id
        wanted = [c for c in (columns or names) if c in names]
        part = frames.select(key.alias("set_id"), *wanted)
        if "success" not in names and (columns is None or "success" in columns):
            part = part.withColumn("success", F.lit(1).cast("long"))
        parts.append(part)
    if not parts:
        raise ValueError(f"no AU frame file below {path}")
    frames = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if columns is not None:
        frames = frames.select("set_id", *[c for c in columns if c in frames.columns])
    if sample_fps:
        frames = observed_downsample(frames, sample_fps)
    return detected_frames(frames) if only_success else frames


def rebuild_facial_features(
    spark: SparkSession, path: str, min_valid: int = 10, set_id: Column | None = None
) -> DataFrame:
    """Per-set facial features of all cached frame files in one job."""
    frames = read_au_frames(spark, path, set_id=set_id)
    return facial_summary(frames, min_valid).withColumn("video_name", F.concat("set_id", F.lit(".mp4")))


def read_batches(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Batch CSVs with unioned columns."""
    return stack_tables([spark.read.option("header", True).csv(p) for p in paths])


def keypoint_rows(frames: DataFrame) -> DataFrame:
    """First person's joints: one row per frame and joint, missing as null.

    A frame without people, or whose joint list is not 16 pairs, keeps 16
    missing joints.
    """
    points = F.get(F.col("people"), F.lit(0))["keypoints"]
    whole = (F.size(points) == JOINTS) & F.forall(points, lambda p: F.size(p) == 2)
    empty = F.array_repeat(F.array(F.lit(None).cast("double"), F.lit(None).cast("double")), JOINTS)
    joints = F.when(F.coalesce(whole, F.lit(False)), points).otherwise(empty)

    def value(i: int) -> Column:
        v = F.get(F.col("p"), F.lit(i))
        return F.when(~F.isnan(v), v)

    return frames.select("set_id", "frame_index", F.posexplode(joints).alias("joint", "p")).select(
        "set_id", "frame_index", "joint", value(0).alias("x"), value(1).alias("y")
    )


def read_keypoints(spark: SparkSession, path: str, suffix: str = "_keypoints") -> DataFrame:
    """Keypoint JSON (one array per file, NaN allowed) to joint rows."""
    frames = (
        spark.read.schema(KEYPOINT_FRAMES).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    )
    return keypoint_rows(frames.withColumn("set_id", stem_of_path(F.col("_metadata.file_path"), suffix)))


def read_keypoint_lines(spark: SparkSession, path: str, set_type: T.DataType) -> DataFrame:
    """Keypoint JSON lines (one frame each, which names its set; NaN allowed) to joint rows."""
    schema = T.StructType([T.StructField("set_id", set_type), *KEYPOINT_FRAMES.fields])
    return keypoint_rows(spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path))


#: Fixed value: the first key of each frame in a keypoint file.
FIRST_KEY = '"frame_index"'


def read_keypoint_arrays(spark: SparkSession, path: str, suffix: str = "_keypoints", set_id: Column | None = None) -> DataFrame:
    """As :func:`read_keypoints`, with many tasks per file.

    A file is one JSON array, which a JSON reader takes whole. Here it is read as text that the first key of
    each frame divides, so Spark plans byte ranges of it and each task finds its own frames; what follows the key
    is one frame, but for the brackets of its neighbours. Files may be indented or not. Frames whose first
    key is another stop the job with an error.
    """
    text = spark.read.option("lineSep", FIRST_KEY).text(path)
    key = stem_of_path(F.col("_metadata.file_path"), suffix) if set_id is None else set_id
    parts = text.select(key.alias("set_id"), "value").filter(~F.col("value").rlike(r"^\s*\[?\s*\{?\s*$") & (F.trim("value") != "[]"))
    frame = F.concat(F.lit("{" + FIRST_KEY), F.regexp_replace("value", r"(,\s*\{|\])\s*$", ""))
    options = {"allowNonNumericNumbers": "true", "mode": "FAILFAST"}
    frames = parts.select("set_id", F.from_json(frame, KEYPOINT_FRAMES, options).alias("f"))
    return keypoint_rows(frames.select("set_id", "f.*"))


def list_inputs(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """Files below ``folder`` with one of the extensions, without reading them."""
    pattern = r"\.(" + "|".join(e.lower().lstrip(".") for e in extensions) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return (
        files.select("path", "length", "modificationTime")
        .filter(F.lower("path").rlike(pattern))
        .dropDuplicates(["path"])
        .withColumn("set_id", stem_of_path(F.col("path")))
    )
