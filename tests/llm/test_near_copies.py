"""The pipeline's near copies against a loop over all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setgauge.llm import near_copies, simhash


def slow_sets(texts):
    split = [simhash.WORDS(t.encode().lower()) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def slow_links(sets, least=0.8):
    """All pairs, found through the shingles they share."""
    holders, out = {}, []
    for i, s in enumerate(sets):
        common = Counter(k for h in s for k in holders.get(h, ()))
        out += [(k, i) for k, n in common.items() if n / (len(s) + len(sets[k]) - n) >= least]
        if not s:
            out += [(k, i) for k in range(i) if not sets[k]]
        for h in s:
            holders.setdefault(h, []).append(i)
    return out


def slow_roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_stage_on_documents(spark, name):
    """0.8 on five-word shingles decides, also where fingerprints differ in many bits."""
    folder = f"/root/testdata/{name}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    links = slow_links(slow_sets([r["text"] or "" for r in rows]))
    prints = [simhash.fingerprint(r["text"] or "") for r in rows]
    assert any(((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() > 2 for a, b in links)
    roots = slow_roots(len(rows), links)
    got = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in got) == [r["doc_id"] for i, r in enumerate(rows) if roots[i] == i]


@pytest.mark.parametrize("meeting", [2, 32])
def test_large_groups(spark, monkeypatch, meeting):
    """Clouds of near copies, some chained to each other, by rounds as by all pairs."""
    monkeypatch.setattr(near_copies, "MEETING", meeting)
    rng = random.Random(3)
    texts = []
    for _ in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(70)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    drift = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    for i in range(50):
        drift[i] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(drift))
    rng.shuffle(texts)
    sets = slow_sets(texts)
    links = slow_links(sets)
    roots = slow_roots(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in near_copies.without_near_copies(docs).select("doc_id").collect()}
    assert got == {i for i in range(len(texts)) if roots[i] == i}


def test_rows_are_known_by_id_and_text(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, other), (2, one), (2, other + " end"), (3, one + " end"), (4, None), (5, ""), (None, "no id"), (None, "no id"), (6, one), (6, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["text"] or "") for r in near_copies.without_near_copies(docs).collect())
    assert got == [(1, other), (2, one), (4, ""), (99, "no id")]
    assert near_copies.without_near_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("meeting", [2, 32])
def test_common_passage_and_common_source(spark, monkeypatch, meeting):
    """Texts that share most of a passage but are not similar, beside copies of one text that are similar to it alone."""
    monkeypatch.setattr(near_copies, "MEETING", meeting)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(rng.randrange(8, 30))] + passage + [word() for _ in range(rng.randrange(5))]) for _ in range(150)]
    source = [word() for _ in range(50)]
    for _ in range(150):
        words = list(source)
        for at in rng.sample(range(50), rng.randrange(1, 3)):
            words[at] = word()
        texts.append(" ".join(words))
    texts += [" ".join(source), "the same", " ".join(source[:40])]
    rng.shuffle(texts)
    roots = slow_roots(len(texts), slow_links(slow_sets(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in near_copies.without_near_copies(docs).select("doc_id").collect()}
    assert got == {i for i in range(len(texts)) if roots[i] == i}


def test_columns_of_any_name_and_type(spark):
    rows = [(1, "one two three four five six", {"a": 1}), (1, "one two three four five six", {"a": 2}), (2, "one two three four five six", {"b": 1}), (3, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>")
    clashing = ("_key", "_id", "_of", "_n", "key", "row", "fp", "held", "band", "kept_id", "kept_key", "n", "root", "component", "one")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashing})
    kept = near_copies.without_near_copies(docs)
    got = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == docs.columns and sorted(got) == [1, 3]
    assert got[1]["tags"] == {"a": 1} and all(got[3][c] == f"{c}3" for c in clashing)


def test_simhash_gives_candidates(spark):
    """Without a single band, texts that SimHash links are compared: one pair by equal prints, one within two bits, one not similar."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:200] + ["x"] + words[201:]), "a b c d e f g", "q r s t u v", "k l m n o p"]
    fps = [int(near_copies.node(near_copies.shingles(t))) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.keyed(docs).select("doc_id", "key").collect()
    at = sorted((r["doc_id"], r["key"]) for r in rows)
    nodes = [(fp, len(near_copies.shingles(t)), [], i, key) for fp, t, (i, key) in zip(fps, texts, at)]
    distinct = spark.createDataFrame(nodes, "fp long, n int, bands array<long>, doc_id long, key long")
    prints = spark.createDataFrame([(fps[0], 5), (fps[1], 6), (fps[2], 1 << 40), (fps[3], 1 << 40), (fps[4], -1)], "fp long, print long")
    pairs = {tuple(sorted(r)) for r in near_copies.simhash_pairs(prints).collect()}
    assert pairs == {tuple(sorted(fps[:2])), tuple(sorted(fps[2:4]))}
    got = {r["fp"]: r["root"] for r in near_copies.node_roots(docs, distinct, prints).collect()}
    assert got == {fps[0]: min(fps[:2]), fps[1]: min(fps[:2])}


def test_rows_go_to_python_in_bounded_batches(spark, monkeypatch):
    """Texts and pairs of sets are bounded by bytes, not by a number of rows; the session's own setting is left as it was."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    plain = near_copies.sketches

    def linked(docs, distinct, prints, least):
        seen.append(spark.conf.get(key, None))
        return distinct.select("fp", F.col("fp").alias("root"))

    monkeypatch.setattr(near_copies, "sketches", lambda docs: (seen.append(spark.conf.get(key, None)), plain(docs))[1])
    monkeypatch.setattr(near_copies, "node_roots", linked)
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, None)], "doc_id long, text string")
    assert near_copies.near_copies(docs).count() == 3
    assert all(seen) and spark.conf.get(key, None) is None
    spark.conf.set(key, "1000000")
    try:
        near_copies.near_copies(docs)
        assert seen[2:] == ["1000000"] * 2 and spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)
