"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The first candidates come from SimHash (``simhash.links``): texts whose fingerprints of three-word shingles differ in two
bits or fewer. Pairs of 0.8 often differ in more, so others share one of ``BANDS`` keys, each the hash of ``ROWS`` least
hashes of a text's shingles. A pair of similarity s meets in some band with probability 1 - (1 - s^ROWS)^BANDS: 0.99994
at 0.8, more above. Every candidate pair, of either kind, is then compared exactly, over the full sets.

Texts with the same set are one node. Every node is compared with three of the nodes that it meets:
the smallest, the largest, and the one whose bands hold most nodes, which in a group of copies is what they
were copied from. Where at most ``MEETING`` nodes share a band, all pairs not linked by then are compared.

Fuller bands are not compared as they are, since texts that share a common passage meet there without being
similar. Their nodes are indexed anew, by an exact prefix filter: the shingles of a node in order of rising
frequency among these nodes, and of these the first n - ceil(least n) + 1. Two sets with the similarity ``least`` share
one of them, whatever the bands say, and a common passage is not among them unless it is most of a text. What comes
before the first common one is not shared, which bounds what can be. Where nodes of different components share such a
shingle and the bounds allow it, some outside the largest component, four times as many in each round, are
compared with all of the other components, until none is left that was not compared. So every pair is
compared, linked through others, or proven to be less similar.

Cases: a null text is an empty one, and empty texts are copies of each other. Rows are known by
doc_id and text, so rows of one doc_id and other texts stay apart, and a null doc_id counts as the
largest. An empty table gives an empty table; other columns, of any name and type, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setgauge.llm import simhash
from setgauge.llm.common import chunks, components, cut, discard, gathered, release, small_batches
from setgauge.llm.simhash import WORDS

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
#: Nodes that are all compared with each other where they share a band.
MEETING = 32
MARGIN = 1e-6
#: Shingles hashed at once.
PIECE = 4096

DRAWN = np.random.default_rng(42)
FACTORS = DRAWN.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
TERMS = DRAWN.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; a text of fewer words is one shingle."""
    tokens = WORDS(text.encode("utf-8", "surrogatepass").lower())
    if not tokens:
        return np.empty(0, "<u8")
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], "<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(hashes):
        return []
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), PIECE):
        least = np.minimum(least, (low[at : at + PIECE] * FACTORS + TERMS).min(axis=1))
    rows = least.astype("<u4").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes, not both empty."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, row): a hash of the text tells rows of one doc_id apart; ``row`` is the row as it came."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", key.alias("key"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, n, bands, print): node, number of shingles, band keys and SimHash of each row."""
    picked = keyed(docs).select("doc_id", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sets = [shingles(t) for t in texts]
            columns = [pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array([simhash.fingerprint(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], names=["doc_id", "key", "fp", "n", "bands", "print"])

    return picked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long, n int, bands array<long>, print long")


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) of nodes that SimHash links, from (fp, print): those of one print with the smallest of them, and these with each other."""
    least = prints.groupBy("print").agg(F.min("fp").alias("least"))
    linked = simhash.links(least.select(F.col("print").alias("fp"), F.col("print").alias("first")))
    of_a, of_b = (least.select(F.col("print").alias(c), F.col("least").alias(f"_{c}")) for c in "ab")
    across = linked.join(of_a, "a").join(of_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = prints.join(least, "print").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    out = cut(across.union(same).where("a <> b").distinct(), "near-simhash")
    discard(linked)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, hashes): the set of each node of ``wanted`` (fp, doc_id, key), from the row named there."""
    named = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"), "fp")
    rows = keyed(docs).select("doc_id", "key", "text")
    met = rows.join(named, (F.col("key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = [shingles(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], names=["fp", "hashes"])

    return met.mapInArrow(run, "fp long, hashes binary").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity ``least`` or more; a may be in many pairs."""
    of_b = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("sb"))
    of_a = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("sa"))
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def sizes_fit(n, m, least: float):
    """Sets of sizes further apart cannot be that similar; the margin is for products like 35 * 0.8 that come out above 28."""
    return F.least(n, m) >= F.greatest(n, m) * least - MARGIN


def rests_fit(rest, other_rest, n, m, least: float):
    """Sets of sizes n and m that share so little from their first common shingle on are not that similar."""
    return F.least(rest, other_rest) >= (n + m) * (least / (1 + least)) - MARGIN


def rooted(links: DataFrame) -> DataFrame:
    """(fp, root) of all nodes with a link."""
    found = components(links, "near-roots")
    out = cut(found.select(F.col("node").alias("fp"), "root"), "near-rooted")
    discard(found)
    return gathered(out)


def rare_shingles(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(band, fp, n, rest): the shingles that ``nodes`` (fp, n) are indexed by, of those that at least two share.

    ``rest`` is the number of shingles from there on, the shingle included: if it is the first that two nodes share, they
    share no more than the lesser rest.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, held in zip(batch.column("fp").to_pylist(), batch.column("hashes")):
                hashes = np.frombuffer(held.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), fp, np.int64)), pa.array(hashes)], names=["fp", "band"])

    each = cut(sets.join(nodes.select("fp"), "fp", "left_semi").mapInArrow(spread, "fp long, band long"), "near-shingles")
    counted = each.groupBy("band").agg(F.count("*").alias("held"))
    shared = cut(counted.where("held > 1"), "near-shared")
    # what only one node has comes first; of that the number is enough
    of_both = each.join(shared, "band").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("held", "band"))).alias("known"))
    own = F.col("n") - F.size("known")
    wanted = F.greatest(F.col("n") - F.ceil(F.col("n") * least - MARGIN) + 1 - own, F.lit(0)).cast("int")
    first = nodes.join(of_both, "fp").select("fp", "n", own.alias("own"), F.posexplode(F.slice("known", F.lit(1), wanted)).alias("at", "s"))
    index = cut(first.select("s.band", "fp", "n", (F.col("n") - F.col("own") - F.col("at")).alias("rest")), "near-index")
    # no partner in the band is small enough for what the rest can share
    small = index.groupBy("band").agg(F.min("n").alias("low"))
    useful = cut(index.join(small, "band").where(rests_fit(F.col("rest"), F.col("rest"), F.col("n"), F.col("low"), least)).drop("low"), "near-useful")
    discard(each, shared, index)
    return useful


def node_roots(docs: DataFrame, distinct: DataFrame, prints: DataFrame, least: float = LEAST) -> DataFrame:
    """(fp, root) of the linked nodes of ``distinct`` (fp, n, bands, doc_id, key), one row per node; ``prints`` has (fp, print)."""
    spark = docs.sparkSession
    each = distinct.select("fp", "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("held")).where("held > 1")
    met = cut(each.join(shared, "band"), "near-met")
    alike = simhash_pairs(prints)
    compared = met.select("fp").union(alike.select("a")).union(alike.select("b")).distinct()
    sets = cut(shingle_sets(docs, distinct.join(compared, "fp", "left_semi")), "near-sets")

    # SimHash's pairs, and every node with three of all that it meets; most groups of copies are one component after that
    crowd = met.groupBy("fp").agg(F.sum("held").alias("crowd"))
    central = F.max(F.struct("crowd", "fp"))
    ends = met.join(crowd, "fp").groupBy("band").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), central.alias("central"))
    seen = met.join(ends, "band").groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("central").alias("central"))
    stars = seen.select(F.explode(F.array("low", "high", "central.fp")).alias("a"), F.col("fp").alias("b")).where("a <> b")
    pairs = cut(stars.union(alike.select("a", "b")).distinct(), "near-pairs")
    links = cut(verified(pairs, sets, least), "near-links")
    roots = rooted(links)
    discard(pairs, alike)
    release(spark)

    few = met.where(F.col("held") <= MEETING).join(roots, "fp", "left").select("band", "fp", "n", F.coalesce("root", "fp").alias("root"))
    few = cut(few, "near-few")
    left = few.select("band", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = few.select("band", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = left.join(right, "band").where("a < b AND ra <> rb").where(sizes_fit(F.col("na"), F.col("nb"), least)).select("a", "b")
    pairs = cut(pairs.distinct(), "near-pairs")
    links, old = cut(links.union(verified(pairs, sets, least)), "near-links"), (links, roots)
    roots = rooted(links)
    discard(few, pairs, *old)
    release(spark)

    crowded = cut(met.where(F.col("held") > MEETING).select("fp", "n").distinct(), "near-crowded")
    large = gathered(rare_shingles(crowded, sets, least))
    first = large
    large = large.withColumn("led", F.lit(False))
    discard(met, crowded)
    release(spark)
    step = 0
    while not large.isEmpty():
        own = F.coalesce("root", "fp")
        placed = cut(large.join(roots, "fp", "left").select("band", "fp", "n", "rest", "led", own.alias("root")), "near-placed")
        together = gathered(placed)  # the comparisons below are spread over tasks all the same
        main = together.groupBy("band", "root").agg(F.count("*").alias("held")).groupBy("band").agg(F.max_by("root", F.struct("held", "root")).alias("main"))
        waiting = together.where("NOT led").join(main, "band").where("root <> main")
        part = F.pmod(F.xxhash64("fp"), F.lit(1 << 2 * step))
        chosen = waiting.groupBy("band", part.alias("part")).agg(F.min(F.struct("fp", "n", "rest", "root")).alias("lead"))
        lead = {"a": "fp", "na": "n", "rest_a": "rest", "of_a": "root"}
        leaders = cut(chosen.select("band", *[F.col(f"lead.{c}").alias(k) for k, c in lead.items()]), "near-leaders")
        discard(*([large] if step else [first]))
        if leaders.isEmpty():
            discard(placed, leaders)
            break
        fits = sizes_fit(F.col("n"), F.col("na"), least) & rests_fit(F.col("rest"), F.col("rest_a"), F.col("n"), F.col("na"), least)
        facing = placed.join(leaders, "band").where("root <> of_a").where(fits)
        pairs = cut(facing.select("a", F.col("fp").alias("b")).distinct(), "near-pairs")
        links, old = cut(links.union(verified(pairs, sets, least)), "near-links"), (links, roots)
        roots = rooted(links)
        led = gathered(leaders)
        again = led.select("band", F.col("a").alias("fp"), F.lit(True).alias("now"))
        still = together.join(led.select("band").distinct(), "band", "left_semi").join(again, ["band", "fp"], "left")
        large = gathered(cut(still.select("band", "fp", "n", "rest", (F.col("led") | F.coalesce("now", F.lit(False))).alias("led")), "near-large"))
        discard(placed, leaders, pairs, *old)
        release(spark)
        step += 1
    discard(sets, links)
    return roots


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, key, component): rows with one component are linked by similarities of ``least`` or more."""
    with small_batches(docs.sparkSession):  # a pair holds two sets, some 10 kB
        rows = cut(sketches(docs), "near-sketches")
        one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("one")
        grouped = rows.groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), one)
        distinct = cut(grouped.select("fp", "n", "bands", "one.doc_id", "one.key"), "near-nodes")
        prints = cut(rows.select("fp", "print").distinct(), "near-prints")
        roots = node_roots(docs, distinct, prints, least)
    groups = cut(rows.join(roots, "fp", "left").select("doc_id", "key", F.coalesce("root", "fp").alias("component")), "near-groups")
    discard(rows, distinct, prints, roots)
    release(docs.sparkSession)
    return groups


def without_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with one of each component: that of the smallest doc_id, of its rows the one that sorts first."""
    groups = near_copies(docs, least)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("one")
    kept = groups.groupBy("component").agg(one).select(F.col("one.doc_id").alias("kept_id"), F.col("one.key").alias("kept_key"))
    counted = groups.groupBy("doc_id", "key").agg(F.count("*").alias("held"))
    stays = kept.join(counted, (F.col("kept_key") == F.col("key")) & F.col("kept_id").eqNullSafe(F.col("doc_id"))).select("kept_id", "kept_key", "held")
    stays = cut(stays, "near-kept")
    discard(groups)
    met = keyed(docs).drop("text").join(stays, (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    once = met.where("held = 1").select("row.*")
    # rows of one doc_id and text; as text, columns of any type compare
    again = met.where("held > 1").groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(again.select("row.*"))
