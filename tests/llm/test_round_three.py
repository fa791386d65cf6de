"""Hard negatives, byte-level BPE and structure repair against plain loops and libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from setgauge.llm import byte_bpe, hard_negatives, structure_repair
from setgauge.llm.queries import QUERIES, tokenizer_path

# 11: hard negatives


def whole(vector):
    return [max(-(1 << 28), min(1 << 28, int(np.floor(256 * float(x))))) for x in vector]


def slow_negatives(rows):
    """rows: distinct (vec_id, label, vector)."""
    good = [(i, label, whole(v)) for i, label, v in dict.fromkeys((i, label, tuple(v)) for i, label, v in rows if None not in (i, label, v) and None not in v and np.isfinite(v).all())]
    out = []
    for a, own, q in good:
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(q, r)), i, label) for i, label, r in good if i != a and len(r) == len(q)]
        for minus, positive, _ in sorted(s for s in scores if s[2] == own)[:5]:
            p = -minus
            found = sorted(s for s in scores if s[2] != own and 50 * p <= -100 * s[0] <= 95 * p)[:3]
            out += [(a, positive, rank, n, p, -s) for rank, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def mined(frame, **sizes):
    found = hard_negatives.mine(frame, F.col("vec_id") % 50 == 0, **sizes)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return made.withColumns({c: F.lit(0) for c in ("q", "n", "home", "part", "key", "rows", "parts", "v")})


@pytest.mark.parametrize("block, group", [(2048, 512), (16, 3)])
def test_negatives_of_clustered_vectors(spark, block, group):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(6, 20))
    rows = []
    for i in range(400):
        label = 0 if i % 3 == 0 else int(rng.integers(1, 40))  # one label with a third of all rows, many small ones
        rows.append((i, label, (middle[i % 6] + rng.normal(size=20) * 0.4).round(1).tolist()))  # rounded: ties
    assert mined(vectors(spark, rows), block=block, group=group) == slow_negatives(rows)


def test_negatives_edge_cases(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, 1, v), (0, 1, v), (1, 1, v), (1, 1, v), (2, 2, [0.5, 0.0, 0.6]), (3, 2, [0.5, 0.0, 0.6]), (4, None, v), (None, 1, v), (5, 1, None), (6, 1, [0.5, None, 1.0]),
        (7, 2, [float("nan"), 0.0, 1.0]), (8, 2, [float("inf"), 0.0, 1.0]), (9, 2, [0.5, 0.1]), (50, 3, []), (51, 3, []), (52, 4, []), (100, 5, v), (150, 6, [0.0, 0.0, 0.0]),
        (151, 6, [0.0, 0.0, 0.0]), (200, 7, [1e30, 0.0, 0.0]), (201, 7, [1e30, 0.0, 0.0]), (202, 8, [7e5, 0.0, 0.0]), (250, 9, [-1.0, 0.0, 0.0]), (251, 9, [1.0, 0.0, 0.0]),
    ]
    got = mined(vectors(spark, rows))
    assert got == slow_negatives(rows) and {r[0] for r in got} >= {0, 50, 150, 200}
    assert mined(vectors(spark, rows).limit(0)) == []


def test_scan_keeps_what_matters():
    """The bits that go early are never among the answers, and most go early for a far block."""
    rng = np.random.default_rng(5)
    q = rng.integers(-60, 60, (500, 32))
    block = hard_negatives.Block(np.arange(500)[::-1], np.zeros(500, np.int64), q)
    for anchor in rng.integers(-60, 60, (20, 32)):
        truth = q @ anchor
        at, scores = block.scan(anchor, np.ones(500, bool), hard_negatives.among_best(4))
        assert scores[hard_negatives.best(at, scores, 4)].tolist() == sorted(truth.tolist(), reverse=True)[:4]
        bottom, top = 1000, 3000
        at, scores = block.scan(anchor, np.ones(500, bool), hard_negatives.in_windows([(bottom, top)], 3))
        inside = np.sort(scores[(scores >= bottom) & (scores <= top)])[::-1][:3]
        assert inside.tolist() == sorted((s for s in truth.tolist() if bottom <= s <= top), reverse=True)[:3]
        assert not len(block.scan(anchor, np.ones(500, bool), hard_negatives.in_windows([(10**7, 2 * 10**7)], 3))[0])


def test_large_whole_numbers_stay_exact():
    big = np.array([[(1 << 28) - 1, 3, 0], [(1 << 28) - 1, 2, 0], [1, 1, 1 << 28]], np.int64)
    block = hard_negatives.Block(np.arange(3), np.zeros(3, np.int64), big)
    at, scores = block.scan(big[0], np.ones(3, bool), hard_negatives.among_best(3))
    assert dict(zip(at.tolist(), scores.tolist())) == {i: sum(int(x) * int(y) for x, y in zip(big[0], r)) for i, r in enumerate(big)}


# 12: byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    import public_tokenizers as public

    assert public.PATTERN == byte_bpe.SPLITS  # so Western texts take the spelled-out split
    return byte_bpe.encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_ids_of_odd_texts(own, library):
    rng = random.Random(3)
    letters = "abcdeéüß 'tsrevml \n\t\r019.,!?\xa0\x85\x1c\x00日本\U0001f600İǆ <|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 4000, " " * 3000 + "x", "\n" * 999, "hello" * 900, "=-" * 900, "".join(rng.choice("abcdefgh") for _ in range(9000)), "éà" * 3000]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_every_character(own, library):
    for first in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1 " for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert own.encode(text) == library.encode_ordinary(text), hex(first)


def test_slices_and_bounded_memory(own, library, monkeypatch):
    text = " ".join(f"word{i}é's" for i in range(3000)) + "  \n end"
    want = library.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "WHOLE", 50)
    monkeypatch.setattr(byte_bpe, "SLICE", 7)
    monkeypatch.setattr(byte_bpe, "MEMORY", 3000)
    monkeypatch.setattr(byte_bpe, "PAIRS", 20)
    assert own.encode(text) == want
    assert len(own.known) < 20 and len(own.pairs) <= 20


def test_byte_bpe_table(spark, small, library):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op12_byte_bpe"](spark, small).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode_ordinary(text)
        packed = hashlib.sha256(b"".join(n.to_bytes(4, "little") for n in ids)).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), packed, hashlib.sha256(text.encode()).hexdigest())


def test_byte_bpe_edge_cases(spark, library):
    rows = [("x", None, 1), ("y", "", 1), (None, " a", 1), (None, " a", 1), ("z", "日本" * 20_000 + " end", 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids int").withColumn("n_tokens", F.lit("clash"))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert encoded.count() == 5 and ids["x"] == ids["y"] == [] and ids["z"] == library.encode_ordinary(rows[-1][1])
    decoded = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(encoded, path).collect()}
    assert decoded["z"].decode() == rows[-1][1] and decoded[None] == b" a"
    assert byte_bpe.digests(docs, path).count() == 5
    assert byte_bpe.digests(docs.limit(0), path).collect() == [] and byte_bpe.encode(docs.limit(0), path).collect() == []


# 13: structure repair


def harmed(rows):
    """(conv_id, turn, role, text) after the damage."""
    out = []
    for c, t, role, text in rows:
        spaced = [" " if x is None else x for x in (role, text)]
        key = ":".join(" " if x is None else str(x) for x in (c, t))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            spaced[1] = ""
        if kind == 2:
            spaced[1] = "".join(x for x in spaced[1] if x not in ".!?")
        if kind == 4:
            spaced[0] = "user"
        out += [(c, t, *spaced)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """(cost, audit, repaired lines) by keeping whole audits per state, every insertion tried."""
    best = {"": (0, "", ())}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                to = follow[state]
                way = (cost + 2, audit + "I", (*lines, f"{names[to]}:"))
                states[to] = min(states.get(to, way), way)
        return states

    for (_, _, role, text), fault in zip(rows, faults(rows)):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                to = follow[state]
                ways.append((to, (cost + 2 + extra, audit + "R", (*lines, f"{names[to]}:{text}"))))
                if role and (state + role[:1]) in ("s", "u", "su", "ua", "au"):
                    ways.append((role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = after
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def slow_reports(rows, conversations):
    out = {}
    for c in conversations:
        own = in_order([r for r in rows if r[0] == c])
        turns = {r[1] for r in own} - {None}
        found = faults(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = slow_repair(own)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def fast_reports(conversations, rows=None, **sizes):
    return {r["conv_id"]: tuple(r[1:]) for r in structure_repair.reports(conversations, rows, **sizes).collect()}


def random_rows(rng, conversations, longest):
    texts = ["Yes.", "No!", "Why?", "cut off", "also cut, ", " \t\n", "", "Done. \r\n", None, "x.\x0b", "…", "Ja.\xa0"]
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(rng.randrange(longest)):
            turn = rng.choice([t, t, t, None, t // 2, t + 3, -t])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "User"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair_of_damaged_conversations(spark, block):
    rows = random_rows(random.Random(block), 60, 25)
    rows += rows[:40]  # repeated rows
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = made.withColumns({c: F.lit("x") for c in ("mark", "times", "fault", "part", "nr", "letters", "step", "cost", "kind")})
    want = slow_reports(harmed(rows), {r[0] for r in rows})
    assert fast_reports(made, structure_repair.damaged(made), block=block) == want


def test_one_long_conversation_over_many_blocks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", f"{t}"])) for t in range(1500)] + [(2, 0, "user", "a.")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert fast_reports(made, block=64) == slow_reports(rows, {1, 2})


def test_many_equal_rows_are_one_run(spark):
    made = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    got = fast_reports(made.withColumn("times", F.lit(50_000).cast("long")))
    assert got == {1: (0, 0, 2 * 49_999, 0, 2 * 49_999, 6 * 49_999, "K" + "D" * 49_999 + "K" + "D" * 49_999, hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())}


def test_crossings_equal_one_pass():
    """Any division gives the audit that one pass over whole audits gives."""
    rng = random.Random(4)
    for _ in range(400):
        rows = [(0, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(rng.randrange(1, 14))]
        kinds = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        runs = [{"role": r[2], "fault": kinds[f], "times": 1} for r, f in zip(rows, faults(rows))]
        tables = structure_repair.tables_of(runs)
        states = [0, *structure_repair.crossings(tables, 0, [c for c, _ in structure_repair.END])]
        audit = "".join(structure_repair.run_letters(r["role"][:1], r["fault"], 1, states[i:]) for i, r in enumerate(runs)) + structure_repair.END[states[-1]][1]
        assert audit == slow_repair(rows)[1]


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "x."), (1, 1, "user", "y."), (2, None, None, None), (3, 5, "user", "z.")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in structure_repair.repaired(made).collect())
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", "x."), (1, 2, "user", "y."), (1, 3, "assistant", ""), (3, 0, "user", "z."), (3, 1, "assistant", "")]
    assert structure_repair.repaired(made.limit(0)).collect() == [] and fast_reports(made.limit(0)) == {}


def test_conversations_without_rows(spark):
    made = spark.createDataFrame([(1, 0, "user", "a."), (None, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert fast_reports(made, made.limit(0)) == {c: (0, 0, 0, 0, 0, 0, "", nothing) for c in (1, None)}
