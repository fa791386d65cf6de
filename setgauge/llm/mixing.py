"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule of weights over training time 0..1. Its
integral says what share of the target is due by any time; inverting that for a document's place
in its source's cumulative words gives the document's training position, and documents are
range-sorted by position. A source whose target is beyond its size is read again from the start.

Places come from prefix sums in two levels: slabs of a hash of the document's id are summed first
(so a source with a third of all rows is spread over thousands of groups), the slabs of a source
are summed up, and a window runs inside each slab.

Cases: a null text counts no words; a null source is a source of its own, last in order; of rows
with the same doc_id the shorter comes first, equal rows are interchangeable; without any words
all targets are 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setgauge.llm.common import cut, discard, ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Weight of a source at the start and at the end of training, linear between, in the same order; each has the integral 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Words of the mix as a multiple of all words, and the most often that a source is read.
SHARE, MOST = 1.5, 2
#: Hex digits of the id's hash that make a slab.
SLAB_DIGITS = 3


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares by weight, at most ``most`` times the size.

    What goes beyond is shared again by weight, until nothing does; each pass reads two sums.
    """
    cap = F.col("source_size") * most
    whole, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    demand, capped, left, before = share * (whole or 0), 0, weights or 1, -1
    while True:
        due = F.lit(demand - capped) * F.col("weight") / F.lit(float(left))
        full = due > cap
        n, capped_now, left_now = sources.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if n == before or not left_now:
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(due))
        before, capped, left = n, capped_now, left_now


def position(begun: Column, schedule: Column) -> Column:
    """Time at which the integral of a linear weight (start, end) reaches the share ``begun``."""
    a, slope = schedule["start"], schedule["end"] - schedule["start"]
    root = F.sqrt(F.greatest(a * a + 2 * slope * begun, F.lit(0.0)))
    # the other form of the quadratic's solution; it holds for a constant weight too
    return F.least(F.greatest(2 * begun / (a + root), F.lit(0.0)), F.lit(1.0))


def cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*values), (index % len(values) + 1).cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """Adds the columns that placing needs to (doc_id, source, text, ...); drops the text."""
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    counted = docs.withColumn("size", count_words(F.col("text"))).withColumn("place", hashed)
    return counted.withColumn("slab", F.substring("place", 1, SLAB_DIGITS)).drop("text")


def placed(rows: DataFrame, sizes: DataFrame, weights: tuple, schedules: tuple, share: float, most: int) -> DataFrame:
    """Adds source_size, target, taken, position and takes to ``rows``; ``sizes`` are the same rows for the sums."""
    slabs = cut(sizes.groupBy("source", "slab").agg(F.sum("size").alias("slab_size")), "mix-slabs")
    listed = ranked(slabs.groupBy("source").agg(F.sum("slab_size").alias("source_size")), ["source"], "mix-sources")
    weighed = listed.withColumn("weight", cycle([F.lit(w) for w in weights], F.col("rank"))).withColumn(
        "schedule", cycle([F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in schedules], F.col("rank"))
    )
    aimed = cut(targets(weighed, share, most).drop("rank", "weight"), "mix-targets")
    discard(listed)
    by_slab = Window.partitionBy("source").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slabs.withColumn("slab_before", F.coalesce(F.sum("slab_size").over(by_slab), F.lit(0)))
        .join(aimed.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("slab").alias("_slab"), "slab_before", "source_size", "target", "schedule")
    )
    inside = Window.partitionBy("source", "slab").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slab") == F.col("_slab")))
        .withColumn("before", F.col("slab_before") + F.col("ahead"))
    )
    due = F.floor("target").cast("long")
    readings = []
    for reading in range(most):
        begun = F.col("before") + reading * F.col("source_size")
        words = F.greatest(F.least(due - begun, F.col("size")), F.lit(0)).cast("long")
        at = F.when(words > 0, position(begun / F.col("target"), F.col("schedule")))
        readings.append(F.struct(F.lit(reading).alias("reading"), words.alias("words"), at.alias("position")))
    taken = sum((r for r in (F.col("takes")[i]["words"] for i in range(most))), F.lit(0)).cast("long")
    return out.withColumn("takes", F.array(*readings)).withColumn("taken", taken).withColumn("position", F.col("takes")[0]["position"])


def plan(
    docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """One row per document, range-sorted by first training position.

    doc_id, source, size, source_size, target, taken (words over all readings), position (null: not
    taken) and ``takes``: words and position of each reading that takes any.
    """
    sizes = cut(sized(docs.select("doc_id", "source", "text")), "mix-sizes")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_first()]
    out = placed(sizes, sizes, weights, schedules, share, most).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "position", F.filter("takes", lambda t: t["words"] > 0).alias("takes")
    )
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(
    docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per reading, range-sorted by training position.

    The document on which a source's target ends keeps only its first words, as many as are taken.
    """
    keyed = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    sizes = cut(sized(docs.select("doc_id", "source", "text")), "mix-sizes")
    read = placed(sized(keyed), sizes, weights, schedules, share, most).select("_row", "size", F.explode("takes").alias("_take"))
    order = [F.col("_take.position"), F.col("_take.reading"), F.col("_row.doc_id")]
    text = F.when(F.col("_take.words") < F.col("size"), first_words(F.col("_row.text"), F.col("_take.words"))).otherwise(F.col("_row.text"))
    columns = [text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return read.where("_take.words > 0").repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, joined by one space."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")
