"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, collocations, filter_audit, html_text, kd_sharding, language_id, packing, partenum, quality_rules, staging, surrogates, token_counts, toxicity,
    vector_graph,
)

#: Vocabulary of the byte-level encoder.
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Vocabulary of the packed sequences.
WORD_BPE = "word_bpe_49k.json"
#: Vocabulary of the token counts.
PIECE_BPE = "piece_bpe_32k.model"
SHARDS = 24
#: Key of the registered queries; a deployment passes a secret of its own.
SURROGATE_KEY = "tidemark"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(
        staging.table(spark, sf_dir, "documents"), staging.table(spark, sf_dir, "labels"),
        ~staging.held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", staging.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(staging.table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *quality_rules.FEATURES[:5], "base_failed", "kept", "quality")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(
        staging.table(spark, sf_dir, "documents"), ~staging.held_out(F.col("doc_id")))
    return found.select(
        "doc_id", staging.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = kd_sharding.shard(staging.table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(staging.table(spark, sf_dir, "pages"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(staging.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.link(staging.table(spark, sf_dir, "documents"), 3, 90)


ORACLES["op10_partenum"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, len(g) AS n FROM grams),
elements AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(g) AS x FROM grams)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common >= 90 * (s.n + t.n - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sizes
  UNION SELECT r.node, l.b FROM reach r JOIN sides l ON l.a = r.seen)
SELECT s.doc_id, s.n AS n_shingles, min(r.seen) AS component_id FROM sizes s JOIN reach r ON r.node = s.doc_id
GROUP BY s.doc_id, s.n
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = staging.table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(documents, public_tokenizers.path(WORD_BPE)))


@query
def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link(staging.table(spark, sf_dir, "embeddings"), 0.93)


ORACLES["op6_vector_graph"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_dot_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM vectors
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c.component_id,
  v.vec_id = c.component_id AS kept FROM vectors v JOIN least c ON c.node = v.vec_id
"""


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = staging.table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(documents, SURROGATE_KEY)


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(staging.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(staging.table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
  FROM words, (SELECT unnest([1, 2, 3]) AS k) lengths),
counts AS (SELECT lang, g, max(k) AS k, count(*) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, g, k, f AS a FROM counts WHERE k >= 2 AND f >= 10),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part),
kept AS (
  SELECT c.lang, c.g, c.k, c.a FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.g
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (SELECT lang, g, a, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, c.cut, x.f AS l, y.f AS r,
    ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:c.cut]
  JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.cut + 1:]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failures(staging.table(spark, sf_dir, "documents"))
    return filter_audit.audit(masks, staging.table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(
    regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
masks AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM texts JOIN firsts USING (t)),
marks AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT chr(65 + i::INT) AS c, 1 << i::INT AS bit FROM range(5) r(i)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
  JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step::INT] AS bit,
    coalesce(list_sum(bits[1:step::INT - 1]), 0)::INT AS earlier FROM orders, range(1, 6) s(step)),
counted AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
