"""Labels, feature tables and prediction history: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import exercise, with_extension
from ..operators.assemble import require_columns

HISTORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("lift_type", T.StringType()),
        T.StructField("predicted_rpe", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("video_name", T.StringType()),
    ]
)


def label_rows(raw: DataFrame) -> DataFrame:
    """Labels keyed by ``Video`` or ``Set``: video_name, exercise_type, rpe."""
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    key = next((c for c in ("Video", "Set") if c in trimmed.columns), None)
    if key is None:
        raise ValueError(f"labels need a column Video or Set; found {trimmed.columns}")
    require_columns(trimmed, ["RPE"])
    named = trimmed.select(with_extension(F.trim(key)).alias("video_name"), F.col("RPE").cast("double").alias("rpe"))
    return named.select("video_name", exercise(F.col("video_name")).alias("exercise_type"), "rpe")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return label_rows(spark.read.option("header", True).csv(path))


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Feature, importance or imputed tables as parquet, csv or json."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def append_history(records: DataFrame, path: str) -> None:
    """Append records; concurrent writers add files instead of rewriting one."""
    records.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY]).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All readable records, from JSON arrays or JSON lines; broken text is left out.

    ISO timestamps with an offset become instants.
    """
    raw = (
        spark.read.schema(HISTORY)
        .option("mode", "PERMISSIVE")
        .option("multiLine", True)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]")
        .json(path)
    )
    return raw.filter(F.col("id").isNotNull())


def read_history_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HISTORY).option("mode", "PERMISSIVE").json(path)
    return raw.filter(F.col("id").isNotNull())


def clear_history(spark: SparkSession, path: str) -> int:
    """Empty the history and return how many records it held."""
    held = read_history_lines(spark, path).count()
    spark.createDataFrame([], HISTORY).write.mode("overwrite").json(path)
    return held
