"""The corpus pipeline: stages that filter, deduplicate, mix and tokenize documents.

Each stage takes the documents that its predecessor kept, written and read again, and returns the
columns of documents; the last returns one row of token digests per document of the mix.

A null text counts as an empty one, repeated rows are copies of each other, an empty table passes
through all stages, and columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setgauge.llm import bpe, mixing, near_copies, suffix_dedup, toxicity
from setgauge.llm.common import cut, table
from setgauge.llm.queries import fold_of, tokenizer_path

#: Bytes of a passage that counts as a repeat; fifty words of two bytes and more have 149 at least.
PASSAGE, PREFIX = 149, 48


def recounted(docs: DataFrame) -> DataFrame:
    """The number of characters follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(5) != 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, that with the smallest id stays.

    SimHash gives the first candidates, bands of least hashes those whose fingerprints differ in more than two bits.
    """
    return near_copies.without_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go from the texts; every document stays."""
    return recounted(suffix_dedup.without_repeats(docs, length=PASSAGE, prefix=PREFIX))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row per reading, in training order."""
    return recounted(mixing.mixed(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", drop_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The stages hash with XXH64 and learn a lexicon, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
