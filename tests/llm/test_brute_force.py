"""Operators against plain loops on small inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setgauge.llm import bpe, chat, license_scan, mixing, quality, simhash, suffix_dedup, toxicity, weighted_sampling
from setgauge.llm.common import components, cut, ranked
from setgauge.llm.queries import QUERIES, fold_of, tokenizer_path


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, i) for i in range(500, 700)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({n for p in links for n in p}, links)
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}


def test_ranked(spark):
    values = [5, 3, None, 9, 3, 1]
    got = ranked(spark.createDataFrame([(v,) for v in values], "k long"), ["k"]).collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 3, 5, 9, None]
    assert sorted(r["rank"] for r in got) == list(range(6))


# 1 and 4: held-out accuracy


def accuracy(spark, folder, query, label, least):
    scored = QUERIES[query](spark, folder)
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    rows = scored.join(truth, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["truth"] for r in rows) / len(rows) >= least


def test_toxicity_held_out(spark):
    accuracy(spark, "/root/testdata/sf0.01", "op1_toxicity", "toxic", 0.96)


def test_quality_held_out(spark):
    accuracy(spark, "/root/testdata/sf0.01", "op4_quality", "quality", 0.95)


def test_folding_and_exceptions():
    model = toxicity.Model(((" idiot ", 6.0), (" idio", 3.0), (" clown ", 6.0)), ("clown fish",))
    weigh = lambda text: toxicity.weigh(toxicity.fold(text), model)
    assert weigh("An 1D10T!") == weigh("you іdіоt") == weigh("ｉｄｉｏｔ") == 6.0  # digits, Cyrillic letters, full width
    assert weigh("idiosyncratic") == 3.0 and weigh("a clown fish") == 0.0 and weigh("a clown, fishing") == 6.0
    assert weigh("id!ot clown") == 12.0 and weigh("") == 0.0


def test_rising_curve():
    knots = quality.rising(np.array([10.0, 10, 10]), np.array([2.0, 1, 9]), np.array([0.1, 0.2, 0.9]))
    assert len(knots) == 2 and knots[0][1] < knots[1][1]


def test_quality_counts_signs_in_statistics():
    assert len(quality.statistics("")) == len(quality.NAMES) == len(quality.statistics("A b!\nC d%"))


# 2: templates


def test_automaton():
    m = license_scan.Automaton("x", "a b <<beginOptional>>c <<var;max=1>><<endOptional>> d <<var;max=2>> e")
    longest = lambda s: m.longest([w.encode() for w in s.split()], 0)
    assert longest("a b d e") == 4 and longest("a b c x d y e") == 7 and longest("a b c d y z e e") == 7
    assert longest("a b x d e") is None and longest("a b d x y z e") is None and longest("a") is None
    with pytest.raises(ValueError):
        license_scan.parts("a <<beginOptional>> b")


def test_phrases_at_word_places():
    found = license_scan.scan_text("The MIT licence? MIT License, MIT license GNU General Public License cc-by", license_scan.automata(()))
    assert (found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == (4, 3, 11, "cc-by,gpl,mit")
    assert license_scan.scan_text("Released under the MIT License.", license_scan.automata(tuple(license_scan.TEMPLATES.items())))["matches"] == [("mit-notice", 0, 5)]


# 3: SimHash


def slow_fingerprint(text, words=3):
    import xxhash

    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for text in [*list(texts.values())[:60], "", "One", "one TWO", "É é É é"]:
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_simhash_query(spark, small, texts):
    rows = QUERIES["op3_simhash"](spark, small).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert prints == {i: simhash.fingerprint(t) % (1 << 64) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups(ids, links)


@pytest.mark.parametrize("max_bits", [2, 4])
def test_links_within_a_cloud(spark, max_bits):
    rng = random.Random(5)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 150:  # more than may meet under one key
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints |= {rng.getrandbits(64) for _ in range(40)}
    prints |= {p ^ 3 for p in list(prints)[::9]}
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    found = simhash.links(spark.createDataFrame(rows, "fp long, first long"), max_bits).collect()
    known = {i: p % (1 << 64) for p, i in rows}
    assert all((known[a] ^ known[b]).bit_count() <= max_bits for a, b in found)
    every = [(a, b) for a in known for b in range(a) if (known[a] ^ known[b]).bit_count() <= max_bits]
    assert groups(known, [tuple(f) for f in found]) == groups(known, every)


# 5: weighted sampling


def jaccard(a, b):
    def weights(text):
        words = collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w)
        return {w: 1 + math.log(n) for w, n in words.items()}

    a, b = weights(a), weights(b)
    most = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    return sum(min(a[k], b[k]) for k in a.keys() & b.keys()) / most if most else 1.0


def test_weighted_sampling(spark, small, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op5_weighted_sampling"](spark, small).collect()}
    ids, errors = sorted(texts), []
    prints = {}
    for i, doc in enumerate(ids):
        text, following = texts[doc], texts[ids[(i + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = rows[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        errors += [row["near_edited"] - jaccard(text, edited), row["near_next"] - jaccard(text, following)]
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.06


# 7: chat


def test_chat_round_trip():
    import public_tokenizers

    t = chat.Template(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    bits = ["\\", "### User:", "###", " ", "</turn>", "\n", "### Assistant:", "a", "</role>", "### Role:", "é", ":", "turn>", "\U0001f600"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "", "x" + "".join(rng.choices(bits, k=2))]), "".join(rng.choices(bits, k=rng.randint(0, 7)))) for _ in range(rng.randint(0, 4))]
        ids = [i for role, text in turns for i in t.turn(role, text)]
        assert t.read(ids) == turns and chat.parse(t.text(ids)) == turns
        mask = t.loss_mask(np.asarray(ids, np.int64))
        assert t.loss_text(ids, mask) == "".join(text for role, text in turns if role == "assistant")


def test_chat_query(spark, small):
    odd = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    talks = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        talks[conv].append((turn, role, text))
    got = {r["conv_id"]: r for r in QUERIES["op7_chat"](spark, small).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(turns), len(learned))
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


# 8: mixing


def test_positions_follow_the_schedule(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 7)) for i in range(900)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for source, (start, end) in zip("ab", mixing.SCHEDULES):
        own = [(t["position"], t["words"]) for r in plan if r["source"] == source for t in r["takes"]]
        target = next(r["target"] for r in plan if r["source"] == source)
        for time in (0.25, 0.5, 0.75):
            due = target * (start * time + (end - start) * time * time / 2)
            assert abs(sum(w for p, w in own if p < time) - due) <= 8
    firsts = [r["position"] for r in plan if r["position"] is not None]
    assert firsts == sorted(firsts)


# 9: repeats


def slow_repeats(texts, length):
    places = collections.Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = [False] * len(t)
        for s in range(len(t) - length + 1):
            if places[t[s : s + length]] > 1:
                covered[s : s + length] = [True] * length
        out.append((len(t), sum(covered), sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered)), hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("length,prefix", [(40, 20), (24, 8), (60, 59)])
def test_repeats(spark, length, prefix):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [word(rng.randint(30, 150)) for _ in range(6)]
    texts = []
    for i in range(90):
        text = word(rng.randint(0, 120)) + (passages[i % 6] if i % 4 else passages[0]) + word(rng.randint(0, 80))
        if i % 9 == 0:
            text += passages[1] + passages[1][:70]  # overlaps and repeats of its own
        if i % 11 == 0:
            text = "ab" * 60 + text
        texts.append(text)
    texts += texts[:5] + ["", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.digests(docs, length=length, prefix=prefix, batches=3).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows}
    for r in rows:
        assert r["n_kept"] == r["n_bytes"] - r["n_removed"] and r["n_kept"] - 4 * (r["n_spans"] + 1) <= len(r["text"].encode()) <= r["n_kept"]
        assert r["n_spans"] or hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    assert got == dict(enumerate(slow_repeats([t.encode() for t in texts], length)))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choices(b"abcdefgh", k=5000))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    runs = list(suffix_dedup.sampled(data, 100, 60))
    assert [s for _, a, b in runs for s in range(a, b + 1)] == list(range(4901))
    assert all(a <= at + 0 and b <= at <= b + 40 or a <= at <= a + 40 for at, a, b in runs)


def test_repeats_query(spark, small, texts):
    rows = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in QUERIES["op9_suffix_dedup"](spark, small).collect()}
    assert rows == dict(zip(texts, slow_repeats([t.encode() for t in texts.values()], 400)))


# 10: BPE


def test_bpe_is_the_library(texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    mine, library = bpe.encoder(path), Tokenizer.from_file(path)
    odd = [chr(i) + "a" + chr(i) + "Bé1" for i in range(1, 600)]
    odd += ["a<|endoftext|>b <|STARTOFTEXT|>", "é ́x", "Σας ΑΣ İ ı", "a\u2028b\u00a0c", "日本語123 qx7zz!!???", "it's I'LL 't", "½ ² ٣٤", "x" * 3000, "qzxjvk" * 50]
    for text in [*odd, *texts.values()]:
        want = library.encode(text, add_special_tokens=False).ids
        ids, n, decoded = mine.encode_and_decode(text)
        assert (ids, n) == (" ".join(map(str, want)), len(want)) and mine.encode(text) == want
        assert decoded == mine.decode(want) == library.decode(want, skip_special_tokens=False)
    assert any(len(mine.cuts(w)) > 1 for w in ("qzxjvk", "zqx"))


def test_bpe_frames(spark, small):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    encoded = bpe.encode(docs, path)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    sums = {r["doc_id"]: r for r in bpe.digests(docs, path).collect()}
    for r in bpe.decode(encoded, path).collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == sums[r["doc_id"]]["decoded_sha256"]
        assert sums[r["doc_id"]]["n_tokens"] == len(ids[r["doc_id"]])


# the pipeline


def test_pipeline(spark, small):
    """Each stage against loops over what its predecessor kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [r.asDict() for r in docs.collect()]
    (_, toxic), (_, near), (_, repeat), (_, mix), (_, encode) = corpus_pipeline.STAGES
    labels = spark.read.parquet(f"{small}/labels.parquet")

    model = toxicity.fit(docs, labels, fold_of(5) != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    stage = cut(toxic(spark, docs, small), "t")
    kept = [r for r in kept if scores[r["doc_id"]] < 0.5]
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted((r.asDict() for r in stage.collect()), key=key) == sorted(kept, key=key)

    split = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate({c: c + 32 for c in range(65, 91)})) for r in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    alike = lambda x, y: x == y or 10 * len(x & y) >= 8 * len(x | y)
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    root = groups(sets, links)
    stage = cut(near(spark, stage, small), "n")
    kept = [r for r in kept if root[r["doc_id"]] == r["doc_id"]]
    assert sorted((r.asDict() for r in stage.collect()), key=key) == sorted(kept, key=key)

    want = slow_repeats([r["text"].encode() for r in kept], corpus_pipeline.PASSAGE)
    stage = cut(repeat(spark, stage, small), "r")
    got = {r["doc_id"]: r for r in stage.collect()}
    for r, (size, removed, _, digest) in zip(kept, want):
        text = got[r["doc_id"]]["text"]
        assert got[r["doc_id"]]["n_chars"] == len(text) and size - removed - 8 <= len(text.encode()) <= size - removed
        if not removed:
            assert text == r["text"] and hashlib.sha256(text.encode()).hexdigest() == digest
    assert len(got) == len(kept)

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(stage).collect()}
    stage = cut(mix(spark, stage, small), "m")
    mixed = collections.Counter()
    for r in stage.collect():
        mixed[r["doc_id"]] += count(r["text"])
    assert {i: n for i, n in plan.items() if n} == dict(mixed)

    out = encode(spark, stage, small)
    assert out.count() == stage.count()
    assert QUERIES.keys() and sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, out.collect()))


def test_curve_of_nearly_separable_rows():
    rng = np.random.default_rng(1)
    label = (np.arange(4000) % 10 == 0).astype(float)
    weight = np.where(label == 1, rng.uniform(15, 200, 4000), np.where(rng.random(4000) < 0.03, rng.uniform(2, 8, 4000), 0))
    at = toxicity.fit_curve(weight, np.full(4000, 300.0), label)
    scores = np.array(toxicity.curve(weight.tolist(), [300] * 4000, at))
    assert ((scores >= 0.5) == label).mean() > 0.99
