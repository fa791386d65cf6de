"""Pose cleaning as a keyed streaming job, and incremental set processing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pose_cleaning import CleaningProfile, PoseCleaner
from ..session import fresh_path

BATCH_FILES = 30
CLEANED = "set_id int, frame_index int, x array<double>, y array<double>, used boolean"


def clean_pose_stream(frames: DataFrame, profile: CleaningProfile, initial: DataFrame | None = None, forget: int | None = None) -> DataFrame:
    """Cleaned poses of a stream of candidate frames (set_id, frame_index, cands).

    A micro-batch may hold any number of files; the frames of a set are sorted inside it. Frames of a
    set that come after a later one of an earlier micro-batch can no longer be cleaned in order, and
    stop the stream with an error instead of changing results. ``initial`` (set_id, state) gives sets
    a start state, as ``pose_cleaning.bootstrap_states`` does for the batch job. The state of a set is
    one pose, its counters and the last frame. A stream that runs on drops it when nothing came for
    ``forget`` milliseconds; with such a timeout Spark keeps running batches, so a job that stops by
    itself must leave it out.
    """
    started = frames.withColumn("boot", F.lit(None).cast("binary"))
    if initial is not None:
        started = frames.join(initial.withColumnRenamed("state", "boot"), "set_id", "left")

    def clean(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("frame_index")
        held, last = state.get if state.exists else (rows["boot"].iloc[0], None)
        if last is not None and rows["frame_index"].iloc[0] <= last:
            raise ValueError(f"set {key[0]}: frame {rows['frame_index'].iloc[0]} arrived after frame {last}")
        cleaner = PoseCleaner(profile)
        cleaner.restore(bytes(held) if held is not None else None)
        made = [cleaner.step(r) for r in rows.itertuples(index=False)]
        state.update((cleaner.save(), int(rows["frame_index"].iloc[-1])))
        if forget:
            state.setTimeoutDuration(forget)
        out = rows[["set_id", "frame_index"]].reset_index(drop=True)
        for at, name in enumerate(("x", "y", "used")):
            out[name] = [m[at] for m in made]
        yield out

    return started.groupBy("set_id").applyInPandasWithState(
        clean, CLEANED, "bytes binary, last int", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> None:
    """Process what is available, append it to ``path`` and stop."""
    query = (
        stream.writeStream.format(form)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_clean_poses(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    profile: CleaningProfile,
    files: int = BATCH_FILES,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Clean candidate frames stored as parquet below ``source``, ``files`` files per micro-batch, oldest first."""
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out, mark = fresh_path(spark, "cleaned"), fresh_path(spark, "cleaned_marks")
    drain(clean_pose_stream(frames, profile, initial), out, mark)
    return spark.read.schema(CLEANED).parquet(out)


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files: int = BATCH_FILES,
    key: str = "set_id",
) -> None:
    """Keep ``work`` (one row per ``key``) up to date with files not seen before, ``files`` per batch.

    A set may be spread over files and batches: each batch recomputes the sets that it touches from
    all their files. Read the results with :func:`latest`. The checkpoint remembers processed files; a
    batch that is run again overwrites its own folder, so results appear once.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(key).distinct()
        whole = spark.read.schema(schema).parquet(source).join(touched, key, "left_semi")
        work(whole).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .parquet(source)
        .writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, out: str, key: str = "set_id") -> DataFrame:
    """Of each set, the row that its last batch gave."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")


def append_history_stream(records: DataFrame, path: str, checkpoint: str, forget: str | None = None) -> list[int]:
    """Append prediction records once each; returns how many rows each batch read.

    Ids that were appended are keyed state of the stream, so a batch looks up its own ids and never reads the history. They are
    kept for good, so a record may be sent again at any time. With ``forget`` (an interval of ``timestamp``) an id is dropped
    that much after its record; records that are later than that are not appended. The stream owns ``path``: records
    that others wrote there are not known to it. Records without an id count as one.
    """
    if forget:
        once = records.withWatermark("timestamp", forget).dropDuplicatesWithinWatermark(["id"])
    else:
        once = records.dropDuplicates(["id"])
    query = (
        once.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
