"""Per-set results kept up to date from new files alone.

A batch reads the frames of its own files, reduces them to one small state per set, and writes these states as a
table of its own, ``deltas/batch=N``; nothing written before is read or changed, and a batch that runs again
overwrites its own table, so every frame counts once. The state of a set is the merge of its rows in all tables.
After every ``fold`` batches the tables so far are merged into one, ``base/upto=N``, whose rows replace them.
A read therefore meets at most one row per set from the base and one per set and later batch, never frames.

States need an operation that merges them in any order, as ``facial.merged_states``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove

BATCH_FILES, FOLD = 30, 16


def children(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers N of the finished tables ``prefix``N in ``folder``, in order; one entry per table since the last fold."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        finished = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(prefix) and files.exists(finished):
            done.append(int(name[len(prefix) :]))
    return sorted(done)


class SetStates:
    """States of all sets below ``out``."""

    def __init__(self, spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame], fold: int = FOLD):
        self.spark, self.out, self.merge, self.fold = spark, out, merge, fold

    def tables(self) -> tuple[int | None, list[int]]:
        """(last batch in the base, batches after it)."""
        bases = children(self.spark, f"{self.out}/base", "upto=")
        upto = bases[-1] if bases else None
        return upto, [n for n in children(self.spark, f"{self.out}/deltas", "batch=") if upto is None or n > upto]

    def paths(self) -> list[str]:
        upto, later = self.tables()
        return ([] if upto is None else [f"{self.out}/base/upto={upto}"]) + [f"{self.out}/deltas/batch={n}" for n in later]

    def add(self, states: DataFrame, batch: int) -> None:
        """Write the states of a batch; a batch that the base holds already is left out."""
        upto, _ = self.tables()
        if upto is not None and batch <= upto:
            return
        states.write.mode("overwrite").parquet(f"{self.out}/deltas/batch={batch}")
        _, later = self.tables()
        if len(later) >= self.fold:
            self.compact()

    def compact(self) -> None:
        """Merge everything into a new base, then remove what it replaces."""
        upto, later = self.tables()
        if not later:
            return
        old = self.paths()
        self.current().write.mode("overwrite").parquet(f"{self.out}/base/upto={later[-1]}")
        remove(self.spark, *old)

    def current(self) -> DataFrame:
        """One state per set."""
        paths = self.paths()
        if not paths:
            raise FileNotFoundError(f"no states in {self.out}")
        return self.merge(self.spark.read.parquet(*paths))


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    reduce: Callable[[DataFrame], DataFrame],
    states: SetStates,
    checkpoint: str,
    files: int = BATCH_FILES,
) -> list[int]:
    """Add the files below ``source`` that were not seen before, ``files`` per batch; rows read by each batch.

    ``reduce`` maps frames to one state per set. The checkpoint remembers the files.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        states.add(reduce(batch), batch_id)

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
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
