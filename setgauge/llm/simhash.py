"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits. Two fingerprints within ``max_bits`` = t differing bits, cut into
m = t + 1 segments on a ring, must have a segment from which every chain of consecutive segments
stays within its proportional budget: the first l segments differ in at most l*t/m bits. So the
first is equal (budget below 1) and the second differs in at most one bit (budget below 2), which
leaves one half of it equal. Fingerprints that share such a first segment and half meet; the
further budgets of the chain prune what met before the full comparison.

Where more than ``MEETING`` fingerprints share a key, as with a cloud of near copies, they are
not paired. Two fingerprints within t bits (t even) have a common point within t/2 bits of each;
every one is sent to its points, and those that share a point are linked to the smallest of them.
That is exact and linear in the number of fingerprints, for groups of any size.

Cases: a null text is an empty one, with fingerprint zero that links like any other. Repeated
rows give repeated rows of one component. Rows with a null doc_id get the component of their
fingerprint. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setgauge.llm.common import components, cut, discard, map_texts

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
BITS = 64
SEED = 42
#: Shingles counted at once.
PIECE = 8192
#: Fingerprints that may be compared with each other where they share a key; more are linked through common points.
MEETING = 32


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of a whole text, as a signed 64-bit number."""
    tokens = WORDS(text.encode("utf-8", "surrogatepass").lower())
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(tokens) - words + 1)
    ends = (starts + lengths)[min(words, len(tokens)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        spans = zip(starts[at : min(n, at + PIECE)].tolist(), ends[at : min(n, at + PIECE)].tolist())
        hashed = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp)."""
    schema = T.StructType([T.StructField("fp", T.LongType())])
    return map_texts(docs, lambda texts: {"fp": [fingerprint(t, words) for t in texts]}, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the max_bits + 1 segments."""
    m = max_bits + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def taken(column, shift: int, width: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) over (fp, first) with one row per fingerprint: enough links to give the components of all within max_bits."""
    if max_bits % 2 or not 0 < max_bits <= 8:
        raise ValueError("max_bits must be 2, 4, 6 or 8")
    ring = segments(max_bits)
    m = len(ring)
    fp = F.col("fp")
    keys = []
    for i, (shift, width) in enumerate(ring):
        after, room = ring[(i + 1) % m]
        half = room // 2
        for h, (s, w) in enumerate([(after, half), (after + half, room - half)]):
            tag = F.lit(2 * i + h).cast("long")
            key = F.shiftleft(F.shiftleft(tag, width).bitwiseOR(taken(fp, shift, width)), w).bitwiseOR(taken(fp, s, w))
            keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    keyed = distinct.select("fp", "first", F.explode(F.array(*keys)).alias("k")).select("fp", "first", "k.start", "k.key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"), "met")

    # few with a key: pairs, pruned by the chain's budgets, then compared in full
    few = met.where(F.col("n") <= MEETING)
    left = few.select("key", "start", F.col("fp").alias("fa"), F.col("first").alias("a"))
    right = few.select("key", F.col("fp").alias("fb"), F.col("first").alias("b"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    within = None
    for i in range(m):
        chain, spent = F.col("start") == i, F.lit(0)
        for length in range(1, m + 1):
            shift, width = ring[(i + length - 1) % m]
            spent = spent + F.bit_count(taken(differ, shift, width))
            chain = chain & (spent <= length * max_bits // m)
        within = chain if within is None else within | chain
    pairs = left.join(right, "key").where("a < b").where(within).where(F.bit_count(differ) <= max_bits).select("a", "b")

    # many with a key: all that share a point hang below the smallest of them
    radius = max_bits // 2
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    flips = [f - (1 << BITS) if f >= 1 << (BITS - 1) else f for f in flips]
    many = met.where(F.col("n") > MEETING).select("fp", "first").distinct()
    points = many.select("first", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"), "fp").select(
        "first", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
    )
    least = points.groupBy("point").agg(F.min("first").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    stars = points.join(least, "point").where("first <> b").select(F.col("first").alias("a"), "b").distinct()
    out = cut(pairs.union(stars).distinct(), "simhash-links")
    discard(met)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable by links of max_bits or fewer differing bits."""
    prints = cut(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    known = distinct.where("first IS NOT NULL")
    roots = components(links(known, max_bits), "simhash-roots").withColumnRenamed("node", "first")
    moved = known.join(roots, "first").select("fp", F.col("root").alias("_root"))
    named = distinct.join(moved, "fp", "left").select("fp", F.coalesce("_root", "first").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest doc_id.

    Of repeated rows with that doc_id one stays, the one that sorts first; rows with a null doc_id stay.
    """
    groups = near_duplicates(docs, words, max_bits)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    repeated = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    again = left.join(repeated, left["doc_id"] == repeated["_again"], "left_semi")
    once = left.join(repeated, left["doc_id"] == repeated["_again"], "left_anti")
    columns = F.struct(*[F.col(c) for c in docs.columns])
    return once.unionByName(again.groupBy("doc_id").agg(F.min(columns).alias("_row")).select("_row.*"))
