"""Session helpers: local session for tests, shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: More than a file of bounded rows holds.
FILE_BYTES = 1 << 30
#: Open scratch blocks, each with the paths handed out in it.
SCOPES: list[list[str]] = []
#: Tasks that run at the same time.
WIDTH = 4


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("setgauge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get(CHECKPOINT_KEY, None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="setgauge-"))  # one machine: its own folder is shared
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(
            f"no shared folder: start the session with {CHECKPOINT_KEY}, or call SparkContext.setCheckpointDir, "
            "naming a folder that the driver and all executors reach"
        )
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; an open :func:`scratch` removes it at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in SCOPES:
        scope.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete what was written below the shared folder, on whatever file system it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        where = hadoop(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, every intermediate table written in it.

    Operators return DataFrames that still read such tables: collect or write their results inside.
    """
    scope: list[str] = []
    SCOPES.append(scope)
    try:
        yield
    finally:
        SCOPES.pop(next(i for i, s in enumerate(SCOPES) if s is scope))
        remove(spark, *scope)


@contextmanager
def unless_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """In the block ``key`` has this value, or what the session already says."""
    own = spark.conf.get(key, None)
    if own is None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)


def cut_lineage(df: DataFrame, name: str = "cut", rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` go to the writer.

    Survives the loss of executors, unlike cached or locally checkpointed
    blocks, and keeps the plans of iterative jobs short. The shuffle files of the write go when it ends, not when the driver
    next collects garbage. With ``rows`` no file has more rows, and a task reads one file;
    that is a setting of a session, so the DataFrame then belongs to one of its own.
    """
    path = fresh_path(df.sparkSession, name)
    if rows:
        options["maxRecordsPerFile"] = str(rows)
    with unless_set(df.sparkSession, CLEAN_KEY, "true"):
        df.write.options(**options).parquet(path)
    reader = df.sparkSession
    if rows:
        reader = reader.newSession()
        for key in ("maxPartitionBytes", "openCostInBytes"):  # a file fills a task, and is not split
            reader.conf.set(f"spark.sql.files.{key}", str(FILE_BYTES))
    out = reader.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what :func:`cut_lineage` wrote, once nothing reads it any more."""
    for df in frames:
        remove(df.sparkSession, df.shared_path)


def concurrently(spark: SparkSession, tasks: Sequence[Callable], width: int = WIDTH) -> list:
    """Results of ``tasks`` in their order, ``width`` at a time, each in a scheduler pool of its own.

    Where jobs are short and follow each other, as in a fit, one task alone leaves most executors
    idle. In FAIR mode the pools share the executors evenly, otherwise in the order of their jobs.
    """

    def in_pool(number: int, task: Callable):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % width}")
            try:
                return task()
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=width) as pool:
        return list(pool.map(lambda task: task(), [in_pool(i, t) for i, t in enumerate(tasks)]))
