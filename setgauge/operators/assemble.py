"""Bringing per-set sources together: merges, upserts, alignment, checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_stem, filled_video_name
from ..functions.numbers import snap
from ..session import cut_lineage
from .tracks import dealt

HEAD_COLUMNS = ["video_name", "rpe", "rep_change_s", "rep_count"]
LEAKAGE = ["total_frames", "detection_count"]
AU_MAX = re.compile(r"AU\d+_max")
#: Rows of both tables that a parity check joins at once.
ROWS_JOINED = 16_000_000


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Raise before any job runs if a required column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; found {df.columns}")
    return df


def columns_like(df: DataFrame, pattern: str | re.Pattern) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def numeric_columns(df: DataFrame, leave_out: Iterable[str] = ()) -> list[str]:
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    skip = set(leave_out)
    return [n for n, t in df.dtypes if (t in numeric or t.startswith("decimal")) and n not in skip]


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*LEAKAGE)


def complete_rows(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target, *numeric_columns(df, [target])])


def ordered_columns(df: DataFrame, head: Sequence[str]) -> DataFrame:
    """Head columns first, the rest sorted by name."""
    return df.select(*head, *sorted(c for c in df.columns if c not in head))


def keyed(df: DataFrame, name: str = "video_name", key: str = "set_id", keep_name: bool = False) -> DataFrame:
    out = df.withColumn(key, file_stem(F.trim(F.col(name).cast("string"))))
    return out if keep_name else out.drop(name)


def outer_merge(left: DataFrame, right: DataFrame, key: str = "set_id") -> DataFrame:
    """Full outer join; columns the left already has are dropped on the right."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    return left.join(right.drop(*shared), key, "full_outer")


def master_table(bar: DataFrame, face: DataFrame, posture: DataFrame, labels: DataFrame) -> DataFrame:
    """One wide row per set; the label is joined last, duplicates multiply rows."""
    require_columns(bar, ["video_name", "rep_change_s", "rep_count"])
    require_columns(face, ["video_name"])
    require_columns(posture, ["video_name", "d_value"])
    require_columns(labels, ["set_id", "rpe"])
    merged = outer_merge(keyed(bar, keep_name=True), keyed(face))
    merged = outer_merge(merged, keyed(posture))
    named = merged.withColumn("video_name", filled_video_name(F.col("video_name"), F.col("set_id")))
    return named.join(labels.select("set_id", "rpe"), "set_id", "left")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_master(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A master table for :func:`upsert_master`: parquet, one folder per bucket of keys."""
    bucketed = rows.withColumn("bucket", _bucket(key, buckets).cast("int"))
    bucketed.repartition("bucket").write.partitionBy("bucket").parquet(path)


def upsert_master(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int = 64) -> None:
    """Rows of ``new`` replace those with the same key in the table of :func:`write_master`.

    Only buckets that hold a key of ``new`` are read and written; the files of all others stay as they are. The new content of
    a bucket is written aside first, then takes the bucket's place. ``buckets`` is that of the table. Repeated
    keys in ``new`` are all kept. Rows without a key are only added.
    """
    fresh = cut_lineage(new.withColumn("bucket", _bucket(key, buckets).cast("int")), "upserts")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most one per bucket
    if not touched:
        return
    base = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    merged = cut_lineage(base.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True), "upserted")
    merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def unprocessed(sets: DataFrame, done: DataFrame, name: str = "video_name") -> DataFrame:
    """Sets whose stem is not among the processed ones."""
    stem = "_stem"
    finished = done.select(file_stem(F.col(name)).alias(stem))
    return sets.withColumn(stem, file_stem(F.col(name))).join(finished, stem, "left_anti").drop(stem)


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("set_id",)) -> DataFrame:
    """Features in trained order; absent or missing ones become 0."""
    present = set(df.columns)
    cells = [
        F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in present else F.lit(0.0).alias(f) for f in features
    ]
    return df.select(*keep, *cells)


def long_features(df: DataFrame, features: Sequence[str], key: str = "set_id", digits: int = 6) -> DataFrame:
    """(key, feature, value) rows; values rounded for comparison."""
    cells = df.select(key, *[(F.round(F.col(f).cast("double"), digits) + F.lit(0.0)).alias(f) for f in features])
    return cells.unpivot([key], list(features), "feature", "value")


def compare_features(expected: DataFrame, produced: DataFrame, rows: int | None = None) -> DataFrame:
    """Matched, missing and extra (key, feature) pairs of two long tables.

    One grouped count instead of three set operations over the same inputs. ``rows``, the number of both
    tables' rows or more, bounds the pairs that one task groups.
    """
    key = expected.columns[0]
    both = expected.select(key, "feature", F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(
        produced.select(key, "feature", F.lit(0).alias("e"), F.lit(1).alias("p"))
    )
    seen = dealt(both, [key, "feature"], rows).groupBy(key, "feature").agg(F.max("e").alias("e"), F.max("p").alias("p"))
    verdict = F.when((F.col("e") == 1) & (F.col("p") == 1), "matched").when(F.col("e") == 1, "missing").otherwise("extra")
    return seen.select(key, "feature", verdict.alias("verdict"))


def parity_report(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Per feature: sets on both sides, equal values, passed or not."""
    key = expected.columns[0]
    a = expected.withColumnRenamed("value", "want")
    b = produced.withColumnRenamed("value", "got")
    joined = a.join(b, [key, "feature"], "full_outer")
    same = F.col("want").eqNullSafe(F.col("got"))
    return joined.groupBy("feature").agg(
        F.count("want").alias("n_expected"),
        F.count("got").alias("n_produced"),
        F.count(F.when(same, F.lit(1))).alias("n_equal"),
        F.min(same).alias("passed"),
    )


def bucket_digests(df: DataFrame, key: str, features: Sequence[str], buckets: int) -> DataFrame:
    """One row per bucket of keys: rows, a checksum that no order of rows changes, and the present values of each feature.

    The checksum adds up a hash per row over the key, the values and which of them are missing.
    """
    # a hash of an array passes over nulls, so it must be told where they are
    cells = F.array(*[F.col(f).cast("double") for f in features])
    missing = F.transform(cells, lambda v: v.isNull())
    row = F.xxhash64(key, cells, missing).cast("decimal(38,0)")
    hashed = df.select(_bucket(key, buckets).alias("bucket"), row.alias("_row"), *features)
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_row").alias("digest"), *[F.count(f).alias(f) for f in features])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.lit(buckets))


def table_parity(expected: DataFrame, produced: DataFrame, features: Sequence[str], key: str = "set_id", buckets: int = 4096, bits: int = 20) -> DataFrame:
    """Per feature: values on both sides, equal ones, passed or not, as :func:`parity_report` of the same tables.

    Both tables are reduced to one checksum per bucket of keys. Where the checksums of a bucket agree, its
    rows are equal and are only counted; rows are joined and compared only in buckets that differ, so equal tables
    cost one aggregate each. Values are compared on a grid of 2^-``bits``.
    """

    def gridded(df: DataFrame) -> DataFrame:
        # over an array: written out per feature, the generated method grew past what the JVM compiles
        cells = F.transform(F.array(*[F.col(f).cast("double") for f in features]), lambda v: snap(v, bits) + 0.0)
        return df.select(key, cells.alias("_cells")).select(key, *[F.col("_cells")[i].alias(f) for i, f in enumerate(features)])

    want, got = cut_lineage(gridded(expected), "want"), cut_lineage(gridded(produced), "got")  # read again where buckets differ
    a, b = (bucket_digests(df, key, features, buckets) for df in (want, got))
    b = b.select("bucket", F.col("n").alias("n_got"), F.col("digest").alias("digest_got"))
    met = cut_lineage(a.join(b, "bucket", "full_outer"), "digests")  # a row per bucket
    agree = F.coalesce((F.col("n") == F.col("n_got")) & (F.col("digest") == F.col("digest_got")), F.lit(False))
    equal = met.filter(agree)
    parts = [equal.agg(*[F.struct(F.sum(f).alias("want"), F.sum(f).alias("got"), F.sum("n").alias("same"), F.lit(True).alias("all")).alias(f) for f in features])]
    odd = met.filter(~agree)
    rows = odd.agg(F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("n_got", F.lit(0)))).first()[0]

    def compared(f: str) -> Column:
        same = F.col(f"w.{f}").eqNullSafe(F.col(f"g.{f}"))
        return F.struct(F.count(f"w.{f}").alias("want"), F.count(f"g.{f}").alias("got"), F.count(F.when(same, F.lit(1))).alias("same"), F.min(same).alias("all")).alias(f)

    slices = math.ceil((rows or 0) / ROWS_JOINED)
    for i in range(slices):  # one after another, so that the disk holds the shuffle of one slice
        mine = odd.filter(F.col("bucket") % slices == i).select("bucket")
        left, right = (df.withColumn("bucket", _bucket(key, buckets)).join(mine, "bucket", "left_semi").drop("bucket") for df in (want, got))
        joined = left.alias("w").join(right.alias("g"), key, "full_outer").agg(*[compared(f) for f in features])
        parts.append(cut_lineage(joined, "compared"))
    both = reduce(DataFrame.unionByName, parts)
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("c")) for f in features])).alias("r"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("r.feature").agg(
        zero("r.c.want").alias("n_expected"), zero("r.c.got").alias("n_produced"), zero("r.c.same").alias("n_equal"), F.min("r.c.all").alias("passed")
    )


def flatten_struct(df: DataFrame, name: str) -> DataFrame:
    """Fields of a struct column as ``<name>_<field>`` columns."""
    fields = df.select(f"{name}.*").columns
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in fields])


def coverage(df: DataFrame, target: str = "rpe") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("sets"), F.count(target).alias("sets_with_rpe"))
