"""The registered query of each operator, with production parameters over its whole table, and its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutledger.llm import (
    collocations, common as cm, fingerprints, jaccard_join, kdtree, langid, packing, pii, secrets, sp_offsets, suffix_dedup, toxicity, varint_ids, whitening)


def op1_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(cm.table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(cm.table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_offsets.encode_digests(cm.table(spark, sf_dir, "documents"), cm.vocabulary("piece_bpe_32k.model"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(cm.table(spark, sf_dir, "documents"))


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(cm.table(spark, sf_dir, "documents"), cm.vocabulary("word_bpe_49k.json"))


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(cm.table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(cm.table(spark, sf_dir, "documents"), length=400)


def op8_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cm.table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varint_ids.token_files(cm.table(spark, sf_dir, "documents"), cm.vocabulary("byte_bpe_50k.json"))


def op10_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(cm.table(spark, sf_dir, "documents"))


def op11_weighted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(cm.table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(cm.table(spark, sf_dir, "documents"))


def op13_nonnegative_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(cm.table(spark, sf_dir, "documents"), cm.table(spark, sf_dir, "labels"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(list_transform(sh, lambda x: hash(x))) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(c.reach) AS component_id
FROM s JOIN c ON c.node = s.doc_id GROUP BY s.doc_id, s.sh
"""

OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
g AS (
  SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) ks)
  GROUP BY ALL),
f AS (SELECT * FROM g WHERE f >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
c AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM s),
d AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, p.f AS l, q.f AS r, (2000000::HUGEINT * c.a) // (p.f + q.f) AS score
  FROM c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.ws[c.cut+1:], ' ')),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, array_to_string(ws[j:j+m-1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM s)) GROUP BY ALL),
o AS (
  SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n, CAST(score AS BIGINT) AS score
FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""

QUERIES = {
    "op1_kdtree_topk": (op1_kdtree_topk, OP1_SQL),
    "op2_ngram_jaccard_join": (op2_ngram_jaccard_join, OP2_SQL),
    "op3_sentencepiece_offsets": (op3_sentencepiece_offsets, None),
    "op4_pii_boosting": (op4_pii_boosting, None),
    "op5_bounded_packing": (op5_bounded_packing, None),
    "op6_linked_secrets": (op6_linked_secrets, None),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_byte_gru": (op8_byte_gru, None),
    "op9_ranked_token_files": (op9_ranked_token_files, None),
    "op10_one_permutation_minhash": (op10_one_permutation_minhash, None),
    "op11_weighted_whitening": (op11_weighted_whitening, None),
    "op12_phrase_collocations": (op12_phrase_collocations, OP12_SQL),
    "op13_nonnegative_toxicity": (op13_nonnegative_toxicity, None),
}
