"""The pipeline's passages of fifty short words."""

import random

import corpus_pipeline


def test_fifty_short_words_go(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = " ".join(word(2) for _ in range(51))
    assert 149 <= len(passage) < 250
    texts = [" ".join(word(8) for _ in range(40)) + f"{end} {passage} {end}" + " ".join(word(8) for _ in range(40)) for end in "xy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert got == {i: t.replace(f" {passage} ", "") for i, t in enumerate(texts)}
