"""Shared helpers: tables, text batches, lineage cuts, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Rows of a text batch handled at once inside a task.
CHUNK_CHARS = 4_000_000
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4_000_000
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a table, or links, that are worked on in one partition.
FEW = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


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


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back; survives lost executors.

    The shuffle files of the write go when it ends, not when the driver next collects garbage.
    """
    path = shared_path(df.sparkSession, name)
    with unless_set(df.sparkSession, CLEAN_KEY, "true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what :func:`cut` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "shared_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in the block hands rows to Python about BATCH_BYTES at a time, or as the session already says.

    A batch otherwise has 10,000 rows of any length, and the executor and its worker both hold it whole.
    """
    with unless_set(spark, BATCH_KEY, str(BATCH_BYTES)):
        yield


def gathered(df: DataFrame) -> DataFrame:
    """What :func:`cut` wrote, in one partition if it has FEW rows at most: its joins and groups then need no shuffles."""
    if df.count() > FEW:
        return df
    out = df.coalesce(1)
    out.shared_path = df.shared_path
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about CHUNK_CHARS bytes in each, or one row."""
    for batch in batches:
        sizes = batch.column(column)
        start, held = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + n > CHUNK_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    docs: DataFrame, work: Callable[[list], dict[str, list]], schema: T.StructType, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``work`` maps a list of texts (null: empty) to columns; ``schema`` names them after the id.

    Runs in whatever partitions the input has; nothing is shuffled.
    """
    out_schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), *schema.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in chunks(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            columns = work(texts)
            if arrow is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                arrow = to_arrow_schema(out_schema)
            arrays = [batch.column(0)] + [pa.array(columns[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    picked = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, out_schema)


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without an edge are absent.

    ``edges`` has long columns a and b. Alternates large-star and small-star steps (every node
    of a group passes its neighbours on to the smallest one), so groups of any size collapse in
    logarithmically many rounds. Minima are pre-aggregated before the shuffle and come back by
    a join that adaptive execution can split, so a hub with a third of all edges is no hot task.
    Each round is written to the shared folder. FEW links at most are one partition in all rounds,
    since a round of many tasks with a handful of links each is almost all overhead.
    """
    current = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    before = None
    while True:
        current = gathered(current)
        # large star: neighbours above a node hang below the smallest of all its neighbours
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = current.select(F.explode(ways).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours hang below the smallest of them
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = after
        if state == before:
            out = current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
            out.shared_path = current.shared_path
            return out
        before = state


def ranked(df: DataFrame, keys: list[str], name: str = "ranked") -> DataFrame:
    """``df`` with the long column ``rank``: 0, 1, ... in ascending order of ``keys``, nulls last.

    Rows are range-partitioned and sorted, numbered inside their partition, written once, and
    shifted by the number of rows in lower partitions (one count per partition).
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    kept = cut(ordered.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1)), name)
    counts = kept.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row per partition
    total, before = 0, {}
    for row in sorted(counts):
        before[row["_part"]] = total
        total += row["n"]
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    rank = F.col("_place") + (shift[F.col("_part")] if before else F.lit(0))
    out = kept.withColumn("rank", rank.cast("long")).drop("_place", "_part")
    out.shared_path = kept.shared_path
    return out
