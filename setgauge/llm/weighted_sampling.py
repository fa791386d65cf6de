"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its words, the weight of a term is 1 + ln(count). Every term falls into one
of ``BINS`` bins by its hash. In each bin one term is sampled consistently: with r and c drawn from
gamma distributions of shape 2 and b uniform, all three from the hash of the term alone, the weight
w gives the level t = floor(ln w / r + b) and the rank c / exp(r (t - b) + r), and the term and level
of least rank are the sample. Two texts sample the same term and level with the probability
sum(min(w)) / sum(max(w)) of a bin, so the share of equal samples among the bins that either text
fills estimates their generalised Jaccard similarity. One draw per term (rather than one per term
and sample) keeps the work linear in the text.

Cases: null texts are empty; a text without words has an empty fingerprint, which is like another
empty one (1) and unlike any other (0). Null doc_ids are one document that follows all others.
Repeated rows give repeated rows; where they are the next document, the row with the least hash of
its text is taken. An only document is its own next. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setgauge.llm.common import cut, discard, ranked, release

#: Samples of a fingerprint; a sample is its bin and CODE_BITS bits of the hash of term and level.
BINS, CODE_BITS = 64, 16
BLANK = r"[\x20\x09-\x0D]+"
#: Order of ranks kept when a sample is packed into a long: bin, rank in steps of 2^-33 from -64 on, code.
RANK_BITS = 41
LAST_ID = (1 << 63) - 1


def either(condition: Column, filled: Column) -> Column:
    return F.when(condition, filled).otherwise(F.array().cast("array<int>"))


def uniform(hashed: Column, upper: bool) -> Column:
    """A number between 0 and 1 from half of a hash."""
    half = F.shiftrightunsigned(hashed, 32) if upper else hashed.bitwiseAND(F.lit((1 << 32) - 1))
    return (half + F.lit(0.5)) / F.lit(float(1 << 32))


def gamma2(hashed: Column) -> Column:
    """A draw of the gamma distribution with shape 2: minus the log of a product of two uniforms."""
    return -F.log(uniform(hashed, True) * uniform(hashed, False))


def boundaries(sorted_array: str, differs) -> Column:
    """Places of a sorted array at which a new run begins."""
    a = F.col(sorted_array)
    places = either(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1))
    return F.filter(places, lambda i: (i == 0) | differs(F.get(a, i), F.get(a, i - 1)))


def signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the array column ``name``: the samples of ``text``, bin and code in one int, by bin."""
    words = F.array_remove(F.split(F.lower(F.col(text)), BLANK), "")
    df = df.withColumn("_h", F.sort_array(F.transform(words, lambda w: F.xxhash64(w))))
    df = df.withColumn("_at", boundaries("_h", lambda x, y: x != y))
    terms = F.transform(
        "_at",
        lambda i, j: F.struct(F.get(F.col("_h"), i).alias("term"), F.log((F.coalesce(F.get(F.col("_at"), j + 1), F.size("_h")) - i).cast("double")).alias("count")),
    )
    # ln w with w = 1 + ln(count); r, ln c and b follow from the term
    drawn = F.transform(
        terms,
        lambda t: F.struct(
            t["term"].alias("term"),
            F.log1p(t["count"]).alias("weight"),
            gamma2(F.xxhash64(t["term"], F.lit(1))).alias("r"),
            F.log(gamma2(F.xxhash64(t["term"], F.lit(2)))).alias("c"),
            uniform(F.xxhash64(t["term"], F.lit(3)), True).alias("b"),
        ),
    )
    levelled = F.transform(drawn, lambda t: F.struct(t["term"].alias("term"), t["r"].alias("r"), t["c"].alias("c"), t["b"].alias("b"), F.floor(t["weight"] / t["r"] + t["b"]).alias("level")))

    def packed(t: Column) -> Column:
        rank = t["c"] - t["r"] * (t["level"] - t["b"]) - t["r"]
        step = F.least(F.greatest((rank + 64) * F.lit(float(1 << 33)), F.lit(0.0)), F.lit(float((1 << RANK_BITS) - 1))).cast("long")
        code = F.xxhash64(t["term"], t["level"]).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
        return F.shiftleft(F.shiftleft(t["term"].bitwiseAND(F.lit(BINS - 1)), RANK_BITS).bitwiseOR(step), CODE_BITS).bitwiseOR(code)

    df = df.withColumn("_p", F.sort_array(F.transform(levelled, packed)))
    of_bin = RANK_BITS + CODE_BITS
    df = df.withColumn("_at", boundaries("_p", lambda x, y: F.shiftright(x, of_bin) != F.shiftright(y, of_bin)))
    low = F.lit((1 << CODE_BITS) - 1)
    sample = F.transform(
        "_at", lambda i: F.shiftleft(F.shiftright(F.get(F.col("_p"), i), of_bin), CODE_BITS).bitwiseOR(F.get(F.col("_p"), i).bitwiseAND(low)).cast("int")
    )
    return df.withColumn(name, sample).drop("_h", "_at", "_p")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples among the bins that either fills."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, CODE_BITS)), F.transform(b, lambda x: F.shiftright(x, CODE_BITS))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_text(samples: Column) -> Column:
    """Six hex digits a sample: bin and code."""
    return F.lower(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, samples, fingerprint)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return signature(rows, "text", "samples").select("doc_id", "samples", as_text(F.col("samples")).alias("fingerprint"))


def next_ids(rows: DataFrame) -> DataFrame:
    """(id, next_id): the following id in ascending order, after the last the first."""
    order = ranked(rows.select("id").distinct(), ["id"], "fingerprint-order")
    first = order.where("rank = 0").select(F.col("id").alias("_first"))
    after = order.select((F.col("rank") - 1).alias("rank"), F.col("id").alias("next_id"))
    followed = order.join(after, "rank", "left")
    lowest = first.first()
    return followed.select("id", F.coalesce("next_id", F.lit(lowest[0] if lowest else None).cast("long")).alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts, of the texts with their last quarter replaced by the next one's beginning, and their likenesses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("text"))
    order = cut(next_ids(rows), "next-ids")
    tail = rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).alias("tail"))
    wanted = order.join(tail, "id").groupBy(F.col("next_id").alias("_next")).agg(F.max("tail").alias("_most"), F.min("id").alias("_before"))
    begun = rows.join(wanted, F.col("id") == F.col("_next")).select(
        F.col("_before").alias("id"), F.col("text").substr(F.lit(1), F.col("_most").cast("int")).alias("begin"), F.xxhash64("text").alias("_hash")
    )
    begun = cut(begun.groupBy("id").agg(F.min(F.struct("_hash", "begin")).alias("_b")).select("id", F.col("_b.begin").alias("begin")), "beginnings")
    release(docs.sparkSession)  # the shuffle of the texts for the beginnings, before that for the edited texts
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    both = rows.join(begun, "id").withColumn("n_chars", n.cast("long")).withColumn("hash", F.xxhash64("text"))
    both = both.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("begin").substr(F.lit(1), quarter)))
    both = signature(signature(both, "text", "samples"), "edited", "edited_samples")
    done = cut(both.select("doc_id", "id", "hash", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "samples", "edited_samples"), "signatures")
    discard(begun)
    release(docs.sparkSession)
    following = done.groupBy("id").agg(F.min(F.struct("hash", "samples")).alias("_s")).select(F.col("id").alias("next_id"), F.col("_s.samples").alias("next_samples"))
    out = done.join(order.join(following, "next_id").select("id", "next_samples"), "id")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("samples")).alias("fingerprint"),
        as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
