"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

A string of ``length`` bytes that starts at two places gives the same sample at both: among the
first ``length - prefix + 1`` positions of the string, the one where a hash of eight bytes is least.
So only the suffixes at such positions are indexed, about two of every ``length - prefix + 1``. A
sampled suffix stands for the run of strings that chose it, and has a key (hash of its first
``prefix`` bytes, which all those strings contain) and a class (hash of all bytes of the run).

Batches of documents come one by one. A batch gets its sorted array of suffix keys; that is scanned
against the arrays of all existing levels, keys met on either side are shared, and levels of equal
size merge into one of double size before the next batch, so there are logarithmically many.

Only suffixes with shared keys go on. A run whose class occurs twice is removed whole. Where a key
has several classes, a repeat begins or ends nearby: one run of each class is spelled out string by
string, and the strings that occur twice are removed. Keys, classes and strings are compared by
64-bit hashes of their bytes; counts are summed before the shuffle and joined back, so a passage in
a third of all documents makes no hot task.

Suffixes are sampled because arrays of all suffixes exceed the time and disk allowed (see README).

Cases: null texts are empty; texts shorter than ``length`` stay whole; overlaps with itself count;
repeated rows are copies of each other, also where they share a doc_id; null doc_ids are kept apart by
their text. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setgauge.llm.common import chunks, cut, discard, release

LENGTH, PREFIX = 400, 256
#: Batches that a table is indexed in; strings of a text looked at together.
BATCHES = 4
PIECE = 1 << 20
#: Low bits of a sampling hash hold the position.
PLACE_BITS = np.uint64(24)


def sampled(data: bytes, length: int, prefix: int) -> Iterator[tuple[int, int, int]]:
    """(sampled position, first and last start of the strings that chose it), in order."""
    last = len(data) - length
    for begin in range(0, last + 1, PIECE):
        piece = np.frombuffer(data[begin : begin + PIECE + length - 1], np.uint8)
        starts = len(piece) - length + 1
        width = length - prefix + 1
        eight = np.lib.stride_tricks.sliding_window_view(piece, 8)[: len(piece) - prefix + 1]
        mixed = np.ascontiguousarray(eight).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        ranks = (mixed >> PLACE_BITS << PLACE_BITS) | np.arange(len(mixed), dtype=np.uint64)
        # least rank of each stretch of width positions, from running minima within blocks of that width
        padded = np.concatenate([ranks, np.full(-len(ranks) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(padded, axis=1).ravel()
        least = np.minimum(ahead[:starts], behind[width - 1 : width - 1 + starts])
        chosen = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        firsts = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
        lasts = np.concatenate((firsts[1:], [starts])) - 1
        yield from zip((chosen[firsts] + begin).tolist(), (firsts + begin).tolist(), (lasts + begin).tolist())


def suffix_rows(data: bytes, length: int, prefix: int) -> tuple[list, list, list, list]:
    """key, class, first start and number of strings of each sampled suffix."""
    keys, classes, starts, counts = [], [], [], []
    for at, first, last in sampled(data, length, prefix) if len(data) >= length else ():
        keys.append(xxhash.xxh3_64_intdigest(data[at : at + prefix]))
        classes.append(xxhash.xxh3_64_intdigest(data[first : last + length], (at - first) << 24 | (last - first)))
        starts.append(first)
        counts.append(last - first + 1)
    return keys, classes, starts, counts


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


SUFFIXES = "doc_id long, check long, key long, class long, start int, strings int"


def suffixes(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """One row per sampled suffix of each document; a document is known by its id and the CRC-32 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, owners, checks, columns = batch.column("doc_id"), [], [], ([], [], [], [])
            for i, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                rows = suffix_rows(data or b"", length, prefix)
                for column, values in zip(columns, rows):
                    column += values
                owners += [i] * len(rows[0])
                checks += [zlib.crc32(data or b"")] * len(rows[0])
            keys, classes, starts, counts = columns
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owners, pa.int64())), pa.array(checks, pa.int64()), pa.array(signed(keys)), pa.array(signed(classes)), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())],
                names=["doc_id", "check", "key", "class", "start", "strings"],
            )

    long = docs.select(F.col("doc_id").cast("long"), "text").where(F.octet_length("text") >= length)
    return long.mapInArrow(run, SUFFIXES)


class Levels:
    """Sorted arrays of (key, n) for 1, 2, 4, ... batches, on disk; tells which keys new batches share."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch of suffix rows; returns the keys that it shares with itself or a level."""
        self.merge()
        array = cut(batch.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "level")
        shared = array.where("n > 1").select("key")
        for _, level in self.levels:
            shared = shared.union(array.join(level.select("key"), "key", "left_semi").select("key"))
        self.levels.append((1, array))
        return cut(shared.distinct(), "shared-keys")

    def merge(self) -> None:
        """Merge levels of equal size, the smallest first."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = cut(a.union(b).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), "level")
            discard(a, b)
            self.levels.append((2 * n, both))

    def drop(self) -> None:
        discard(*(level for _, level in self.levels))


def spelled_out(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(doc_id, check, hash, start, twice): every string of the runs, from the texts."""
    grouped = runs.groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "strings", "twice")).alias("runs"))
    grouped = grouped.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), "runs")
    met = with_check(docs).join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = batch.column("doc_id")
            owners, hashes, starts, twices = [], [], [], []
            for i, (data, own) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist())):
                for r in own:
                    places = range(r["start"], r["start"] + r["strings"])
                    hashes += [xxhash.xxh3_64_intdigest(data[s : s + length]) for s in places]
                    starts += places
                    twices += [r["twice"]] * len(places)
                    owners += [i] * len(places)
            taken = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(taken), batch.column("check").take(taken), pa.array(signed(hashes)), pa.array(starts, pa.int32()), pa.array(twices, pa.bool_())],
                names=["doc_id", "check", "hash", "start", "twice"],
            )

    return met.select("doc_id", "check", "text", "runs").mapInArrow(run, "doc_id long, check long, hash long, start int, twice boolean")


def with_check(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.crc32(text.cast("binary")).alias("check"))


def repeats(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, batches: int = BATCHES) -> DataFrame:
    """(doc_id, check, start, stop) in bytes: stretches covered by strings that also start elsewhere; they may overlap."""
    if not 8 <= prefix < length or length - prefix >= 1 << 15:
        raise ValueError("prefix must be at least 8 and less than length")
    spark = docs.sparkSession
    rows = cut(suffixes(docs, length, prefix), "suffixes")
    batch_of = F.pmod(F.xxhash64("doc_id", "check"), F.lit(batches))
    family, found = Levels(), []
    for b in range(batches):
        found.append(family.add(rows.where(batch_of == b)))
    family.drop()
    release(spark)
    # tables of their own, so that adaptive execution can split a hot key on the other side of the join
    shared = cut(reduce(DataFrame.union, found).distinct(), "shared-keys")
    met = cut(rows.join(shared, "key", "left_semi"), "shared-suffixes")
    discard(rows, shared, *found)
    release(spark)
    least = F.min(F.struct("doc_id", "check", "start", "strings")).alias("one")
    classes = cut(met.groupBy("key", "class").agg(F.count("*").alias("n"), least), "suffix-classes")
    whole = met.join(classes.where("n > 1").select("key", "class"), ["key", "class"], "left_semi")
    stretches = cut(whole.select("doc_id", "check", "start", (F.col("start") + F.col("strings") - 1 + length).alias("stop")).distinct(), "stretches")
    several = cut(classes.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1").select("key"), "several-classes")
    runs = classes.join(several, "key", "left_semi").select("one.*", (F.col("n") > 1).alias("twice"))
    strings = cut(spelled_out(docs, runs, length), "strings")
    discard(met, classes, several)
    release(spark)
    again = cut(strings.groupBy("hash").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("hash"), "again")
    single = strings.where("NOT twice").join(again, "hash", "left_semi").select("doc_id", "check", "start", (F.col("start") + length).alias("stop"))
    out = cut(stretches.union(single), "repeats")
    discard(stretches, strings, again)
    release(spark)
    return out


def merged(stretches: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal stretches, in order."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def per_document(docs: DataFrame, found: DataFrame, carry: list[str], schema: T.StructType, work) -> DataFrame:
    """``work`` maps (carried values, text as bytes, merged stretches) to a row of ``schema``."""
    grouped = found.groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "stop")).alias("found"))  # places within one text
    grouped = grouped.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), F.col("found").alias("_found"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("_own"), text.alias("text"), F.crc32(text.cast("binary")).alias("_crc"))
    met = rows.join(grouped, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_check")), "left").select("row", "text", "_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in chunks(batches):
            rows = []
            for row, data, stretches in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_found").to_pylist()):
                rows.append(work(row, data, merged([(s["start"], s["stop"]) for s in stretches or ()])))
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in arrow], schema=arrow)

    return met.mapInArrow(run, schema)


def kept_pieces(data: bytes, stretches: list[list[int]]) -> list[bytes]:
    edges = [0, *(e for s in stretches for e in s), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2])]


DIGEST = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    T.StructField("n_kept", T.LongType()), T.StructField("text", T.StringType()),
]


def digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, and the text that is left (without halves of characters)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *DIGEST])

    def work(row, data, stretches):
        kept = b"".join(kept_pieces(data, stretches)) if stretches else data
        counts = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(stretches), "n_kept": len(kept)}
        return row | counts | {"kept_sha256": hashlib.sha256(kept).hexdigest(), "text": kept.decode("utf-8", "ignore")}

    return per_document(docs, repeats(docs, **settings), ["doc_id"], schema, work)


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with their repeats removed; a character cut in two goes with them."""

    def work(row, data, stretches):
        if stretches:
            row["text"] = b"".join(kept_pieces(data, stretches)).decode("utf-8", "ignore")
        return row

    return per_document(docs, repeats(docs, **settings), docs.columns, docs.schema, work)
