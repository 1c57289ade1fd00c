"""The ten operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm import additive_quantisation, bagminhash, chat, exact_dedup, licenses, mixing, packing, quality_crf, tokens, toxicity
from timeweave.llm.common import table

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), BPE_JSON, BPE_RANKS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE_JSON, BPE_RANKS, max_len=1024)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return additive_quantisation.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_license_scans": op3_license_scans,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_OP4 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM per),
ranked AS (SELECT *, cap / weight AS reach, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k, sum(source_size) OVER ()::DOUBLE AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM weighed),
level AS (SELECT arg_min((budget - capped) / free, (reach, k)) AS l FROM ranked WHERE (budget - capped) / free <= reach),
targets AS (SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, weight * l) END AS target FROM ranked, level),
placed AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, source, size, cum, e, cum + e * source_size AS done, target FROM placed, range(3) c(e) WHERE size > 0 AND cum + e * source_size - size < target),
queued AS (SELECT *, CASE WHEN done <= target THEN 0.0 ELSE done / target END AS finish FROM copies),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, cum, e ROWS UNBOUNDED PRECEDING) AS words FROM queued),
taken AS (SELECT doc_id, source, cum, sum(size)::BIGINT AS taken FROM run WHERE finish = 0 OR words <= (SELECT sum(target) FROM targets) GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id AND p.source IS NOT DISTINCT FROM t.source AND p.cum = t.cum"""

_OP5 = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scans": licenses.oracle_sql(),
    "op4_mixing": _OP4,
    "op5_exact_dedup": _OP5,
    "op7_chat_formatting": chat.ORACLE_SQL,
}
