"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setgauge.llm import bpe, chat, embedding_dedup, license_scan, mixing, quality, simhash, suffix_dedup, toxicity, weighted_sampling
from setgauge.llm.queries import tokenizer_path

LONG = "word " * 30_000 + "end"
ROWS = [
    (1, None, "en", None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, "a", 6),
    (4, "One two three four five six seven eight.", "en", "b", 40),
    (5, "One two three four five six seven eight.", "en", "b", 40),
    (6, LONG, "en", "b", len(LONG)),
    (7, "İstanbul ß Σας 日本語 \U0001f600 MIT License", "xx", None, 30),
    (7, "İstanbul ß Σας 日本語 \U0001f600 MIT License", "xx", None, 30),
    (None, "a text without an id", "en", "c", 20),
]
CLASH = ("size", "rank", "key", "class", "check", "start", "fp", "first", "label", "score", "samples", "id", "takes", "position", "place", "row", "n", "weight", "raw", "text2")


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return made.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def path():
    return tokenizer_path("word_bpe_49k.json")


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


RESULTS = {
    "toxicity": lambda docs, labels: toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))),
    "licenses": lambda docs, labels: license_scan.scan(docs),
    "simhash": lambda docs, labels: simhash.near_duplicates(docs),
    "quality": lambda docs, labels: quality.score(docs, quality.fit(docs, labels, F.lit(True))),
    "weighted sampling": lambda docs, labels: weighted_sampling.edited_fingerprints(docs),
    "mixing": lambda docs, labels: mixing.plan(docs),
    "repeats": lambda docs, labels: suffix_dedup.digests(docs, length=16, prefix=8),
    "bpe": lambda docs, labels: bpe.digests(docs, path()),
}


@pytest.mark.parametrize("name", RESULTS)
def test_one_row_each(docs, labels, name):
    rows = RESULTS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["doc_id"], r) == r or name == "mixing"  # repeated rows agree


@pytest.mark.parametrize("name", RESULTS)
def test_empty_table(docs, labels, name):
    assert RESULTS[name](docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(docs, labels, name):
    assert RESULTS[name](docs, labels.limit(0)).count() == len(ROWS)


def test_likenesses_of_empty_texts(docs):
    rows = {r["doc_id"]: r for r in weighted_sampling.edited_fingerprints(docs).collect()}
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] == "" and rows[1]["near_next"] == 1.0
    assert rows[3]["n_chars"] == 6 and rows[4]["near_next"] == 1.0 and rows[None]["near_edited"] > 0


def test_empty_fingerprints_link(docs):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[1]["fp"] == rows[3]["fp"] == 0
    assert rows[1]["component_id"] == rows[2]["component_id"] == 1 and rows[5]["component_id"] == 4
    left = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    assert sorted(str(i) for i in left) == ["1", "4", "6", "7", "None"]


def test_mixing_counts(docs):
    rows = mixing.plan(docs).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    taken = sum(r["taken"] for r in rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(mixing.count_words(F.col("text")))).first()[0] == taken


def test_repeats_of_repeated_rows(docs):
    rows = suffix_dedup.digests(docs, length=16, prefix=8).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in rows}
    assert removed[4] == removed[5] == 40 and removed[7] == len("İstanbul ß Σας 日本語 \U0001f600 MIT License".encode())
    assert removed[1] == removed[2] == removed[None] == 0 and removed[6] > 149_000
    cut = suffix_dedup.without_repeats(docs, length=16, prefix=8)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)


def test_vectors(spark):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 0.0, 1.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [float("nan"), 1.0, 0.0], 1), (9, [None, 1.0, 0.0], 1), (10, w, 1), (11, [-0.0, 1.0, -0.0], 1), (12, [1.0, 0.0], 1),
        (13, [1.0, 0.0, 0.5, 0.0], 1), (14, [float("inf"), 0.0, 0.0], 1), (15, [], 1), (None, v, 1), (16, [3e-39, 0.0, 1.5e-39], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x")).withColumn("v", F.lit(0))
    out = embedding_dedup.near_duplicates(table).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[3] == (4, 1, False) and got[16] == (4, 1, False)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    for alone in (4, 5, 6, 7, 8, 9, 12, 13, 14, 15):
        assert got[alone] == (0, alone, True)
    assert got[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y"), (2, 5, "odd </role> role", "### User: \\</turn>"), (2, 1, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    p = tokenizer_path("byte_bpe_50k.tiktoken")
    out = {r["conv_id"]: r for r in chat.digests(chat.encode_turns(table, p, pattern()), p, pattern()).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, None: 1, 2: 2}
    assert out[None]["loss_chars"] == 1 and out[2]["loss_chars"] == 0
    assert chat.digests(chat.encode_turns(table.limit(0), p, pattern()), p, pattern()).collect() == []


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
