"""Pose cleaning of frames that arrive out of order.

Frames carry the time at which they were taken. A frame that continues its set is cleaned at once; one that
runs ahead waits in the set's list state until the frames before it have come, or until the watermark has passed it
and they no longer can. An event-time timer wakes the set for that. A second timer drops the state of a set of which nothing
came for ``forget`` seconds of event time. Frames later than the watermark are not cleaned: Spark counts them as dropped by watermark.

So as long as frames are no later than the watermark's delay, each set is cleaned in its order, and the result
is that of the batch job. State: one pose with its counters, the last frame, and the frames that wait.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pose_cleaning import CleaningProfile, PoseCleaner
from ..session import fresh_path
from .pose_stream import BATCH_FILES, drain

CLEANED = "set_id int, frame_index int, x array<double>, y array<double>, used boolean"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY, FORGET = "10 minutes", 86_400
#: A time after all frames (and one that pandas can hold), and the set of the row that carries it.
CLOSING_TIME, CLOSING_SET = "2200-01-01 00:00:00", -1


class OrderedCleaner(StatefulProcessor):
    """Cleans the frames of one set in their order."""

    def __init__(self, profile: CleaningProfile, forget: int):
        self.profile, self.forget = profile, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pose = handle.getValueState("pose", "held binary, last int, seen long")
        self.waiting = handle.getListState("waiting", "frame_index int, taken long, frame string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, boot = [], None
        for part in rows:
            for row in part.itertuples(index=False):
                boot = row.boot if boot is None else boot
                new.append((int(row.frame_index), int(row.taken_ms), row.frame))
        if key[0] == CLOSING_SET:
            return
        yield from self.clean(key, new, boot, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.pose.exists() and not self.waiting.exists() and self.pose.get()[2] + self.forget <= watermark:
            self.pose.clear()
            return
        yield from self.clean(key, [], None, watermark)

    def clean(self, key, new: list, boot: bytes | None, watermark: int) -> Iterator[pd.DataFrame]:
        held, last, seen = self.pose.get() if self.pose.exists() else (boot, -1, 0)
        frames = sorted([*self.waiting.get(), *new], key=lambda f: f[0])
        cleaner = PoseCleaner(self.profile)
        cleaner.restore(bytes(held) if held is not None else None)
        out, left = [], []
        for index, taken, frame in frames:
            if index <= last:
                continue  # sent twice, or its place was given up when the watermark passed
            if index == last + 1 or taken <= watermark:
                out.append((key[0], index, *cleaner.step(Frame(frame))))
                last = index
            else:
                left.append((index, taken, frame))
            seen = max(seen, taken)
        if last >= 0 or held is not None:
            self.pose.update((cleaner.save(), last, seen))
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(f[1] for f in left))
        else:
            self.handle.registerTimer(seen + self.forget)
        if out:
            yield pd.DataFrame(out, columns=["set_id", "frame_index", "x", "y", "used"])

    def close(self) -> None:
        pass


class Frame:
    """What the cleaner reads of a frame."""

    def __init__(self, frame: str | None):
        self.cands = [candidate(c) for c in json.loads(frame)] if frame else []


def candidate(fields: dict) -> dict:
    """Fields as numbers; JSON leaves out nulls and writes NaN as text."""
    number = lambda v: float(v) if isinstance(v, str) else v
    return {f: [number(v) for v in fields[f]] if f in "xy" else number(fields.get(f)) for f in ("person", "score", "size", "x", "y")}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which this kind of state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def clean_ordered(
    frames: DataFrame, profile: CleaningProfile, initial: DataFrame | None = None, delay: str = DELAY, forget: int = FORGET
) -> DataFrame:
    """Cleaned poses of a stream (set_id, frame_index from 0, taken, cands), however frames of the last ``delay`` are ordered.

    ``initial`` (set_id, state) gives sets a start state, as ``pose_cleaning.bootstrap_states`` does.
    """
    timed = frames.withColumn("taken", F.col("taken").cast("timestamp")).withWatermark("taken", delay)
    if initial is None:
        started = timed.withColumn("boot", F.lit(None).cast("binary"))
    else:
        started = timed.join(initial.withColumnRenamed("state", "boot"), "set_id", "left")
    # as JSON, since nested arrays of arrays do not pass to pandas safely
    rows = started.select("set_id", "frame_index", F.unix_millis("taken").alias("taken_ms"), F.to_json("cands").alias("frame"), "boot", "taken")
    return rows.groupBy("set_id").transformWithStateInPandas(
        statefulProcessor=OrderedCleaner(profile, forget), outputStructType=CLEANED, outputMode="append", timeMode="eventtime"
    )


def run_ordered(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    profile: CleaningProfile,
    files: int = BATCH_FILES,
    initial: DataFrame | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """Clean the frames stored below ``source``, then close the stream, so that nothing waits any more."""
    out, mark, closing = (fresh_path(spark, n) for n in ("ordered_poses", "ordered_marks", "closing"))
    spark.createDataFrame([], schema).write.parquet(closing)
    stream = lambda path: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    cleaned = lambda: clean_ordered(stream(source).unionByName(stream(closing)), profile, initial, delay)
    last = spark.range(1).select(
        *[
            F.lit(CLOSING_SET).cast(f.dataType).alias(f.name)
            if f.name == "set_id"
            else F.lit(CLOSING_TIME if f.name == "taken" else 0 if f.name == "frame_index" else None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
    with rocks(spark):
        drain(cleaned(), out, mark)
        last.write.mode("append").parquet(closing)
        drain(cleaned(), out, mark)
    return spark.read.schema(CLEANED).parquet(out)
