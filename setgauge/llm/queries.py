"""Registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setgauge.llm import (
    bpe, byte_bpe, chat, embedding_dedup, hard_negatives, license_scan, mixing, quality, simhash, structure_repair, suffix_dedup, toxicity, weighted_sampling,
)
from setgauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            CHECKS[name] = sql
        return function

    return add


def template_pattern(tree: list) -> str:
    """The same template as a regular expression over words that each stand between two blanks, for the SQL check."""
    out = []
    for part in tree:
        if isinstance(part, str):
            out.append(f" {part} ")
        elif part[0] == "optional":
            out.append(f"({template_pattern(part[1])})?")
        else:
            out.append(f"( [^ ]+ ){{0,{part[1]}}}")
    return "".join(out)


def license_sql() -> str:
    base = {label: f"' {phrase.replace(' ', '  ')} '" for phrase, label in license_scan.PHRASES.items()}
    n_base = " + ".join(f"(length(p) - length(replace(p, {s}, ''))) // length({s})" for s in base.values())
    first = ", ".join(f"CASE WHEN contains(p, {s}) THEN len(regexp_extract_all(left(p, instr(p, {s}) - 1), '[^ ]+')) END" for s in base.values())
    last = ", ".join(
        f"CASE WHEN contains(p, {s}) THEN n - len(regexp_extract_all(right(p, instr(reverse(p), reverse({s})) - 1), '[^ ]+')) - {s.count('  ') + 1} END"
        for s in base.values()
    )
    based = ", ".join(f"CASE WHEN contains(p, {s}) THEN '{label}' END" for label, s in base.items())
    added = ", ".join(
        f"CASE WHEN regexp_matches(p, '{template_pattern(license_scan.parts(markup))}') THEN '{label}' END"
        for label, markup in license_scan.TEMPLATES.items()
    )
    texts = lambda items: f"array_to_string(list_sort(list_distinct([{items}])), ',')"
    return f"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents),
    padded AS (SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, '  ') || ' ' AS p FROM words),
    found AS (
        SELECT doc_id, n AS n_words, {n_base} AS n_base, least({first}) AS first_word, greatest({last}) AS last_word,
               {texts(based)} AS base_labels, {texts(f"{based}, {added}")} AS labels,
               {texts(added)} AS own
        FROM padded)
    SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
           CASE WHEN own <> '' THEN 1.0 WHEN base_labels <> '' THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM found"""


def fold_of(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(5) != 0)
    scored = toxicity.score(docs, model)
    held = F.coalesce(fold_of(5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(4) != 2)
    scored = quality.score(docs, model)
    held = F.coalesce(fold_of(4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_license_scan", license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_weighted_sampling")
def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


EMBEDDING_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
FROM roots r LEFT JOIN counts c USING (vec_id)"""


@query("op6_embedding_dedup", EMBEDDING_SQL)
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_chat")
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.digests(chat.encode_turns(talks, path, pattern), path, pattern)


MIXING_SQL = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS place
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((nr - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM sources),
levels AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS demand, cap / weight AS ratio FROM weighed),
sums AS (
    SELECT *, demand - coalesce(sum(cap) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)::DOUBLE AS rest,
           sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights
    FROM levels),
level AS (SELECT rest, weights FROM sums WHERE rest / weights <= ratio ORDER BY ratio LIMIT 1),
targets AS (
    SELECT w.source, w.source_size, CASE WHEN l.rest * w.weight / l.weights > w.cap THEN w.cap::DOUBLE ELSE l.rest * w.weight / l.weights END AS target
    FROM weighed w, level l),
placed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(floor(target) - ahead, size), 0) + greatest(least(floor(target) - ahead - source_size, size), 0))::BIGINT AS taken
FROM placed"""


@query("op8_mixing", MIXING_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


NEGATIVE_SQL = """
WITH good AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM ranked WHERE rank <= 3"""


@query("op11_hard_negatives", NEGATIVE_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def repair_sql() -> str:
    """The cheapest edits by a table over whole audits: per row and state the least (cost, audit, text so far)."""
    way = lambda of, cost, letter, line: f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 'r': list_concat({of}.r, {line})}}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    inserted = lambda of, role: way(of, 2, "I", f"['{role}:']")
    twice = lambda of: f"{{'c': {of}.c + 4, 'a': {of}.a || 'II', 'r': list_concat({of}.r, ['user:', 'assistant:'])}}"
    keep = lambda of, to, initial: f"CASE WHEN live AND left(role, 1) = '{initial}' THEN {way(of, 'cut_off', 'K', '[line]')} ELSE {never} END"
    rerole = lambda of, role: f"CASE WHEN live THEN {way(of, '2 + cut_off', 'R', f"['{role}:' || text]")} ELSE {never} END"
    never = "{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    return f"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
spaced AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(
               list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind
    FROM spaced, bits),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nr,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
judged AS (
    SELECT *, shown = '' AS blank, shown <> '' AND seen > 1 AS duplicate,
           shown <> '' AND seen = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nr) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
           count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal, max(nr) AS last
    FROM judged GROUP BY conv_id),
steps AS (
    SELECT conv_id, 0::BIGINT AS read, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS n, {never} AS s, {never} AS u, {never} AS a FROM counted
    UNION ALL
    SELECT conv_id, read, {way("n", 3, "D", "[]::VARCHAR[]")} AS n,
           {least(way("s", 3, "D", "[]::VARCHAR[]"), keep("n", "s", "s"))} AS s,
           {least(way("iu", 3, "D", "[]::VARCHAR[]"), keep("n", "u", "u"), keep("s", "u", "u"), keep("ia", "u", "u"), rerole("n", "user"), rerole("s", "user"), rerole("ia", "user"))} AS u,
           {least(way("ia", 3, "D", "[]::VARCHAR[]"), keep("iu", "a", "a"), rerole("iu", "assistant"))} AS a
    FROM (
        SELECT t.conv_id, t.read + 1 AS read, n, s, {least("u", inserted("n", "user"), inserted("s", "user"), inserted("a", "user"))} AS iu,
               {least("a", inserted("u", "assistant"), twice("n"), twice("s"))} AS ia,
               j.role, j.text, j.role || ':' || j.text AS line, NOT (j.blank OR j.duplicate) AS live, CASE WHEN j.truncated THEN 1 ELSE 0 END AS cut_off
        FROM steps t JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.nr = t.read + 1)),
done AS (
    SELECT t.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, {least("n", "a", inserted("u", "assistant"), twice("s"))} AS best
    FROM steps t JOIN counted c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.last = t.read)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""


@query("op13_structure_repair", repair_sql())
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.reports(conversations, structure_repair.damaged(conversations))
