"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, chat, importance, multi_index, near_vectors, packing, pii, secrets, sharding, simhash, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(text, '') AS said,
         coalesce(nullif(regexp_replace(trim(coalesce(role, '')), '[\s<>|]+', '_', 'g'), ''), 'unknown') AS speaker
  FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
turns AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.said,
         CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM said s JOIN seats p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM turns),
placed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS rendered,
         row_number() OVER w - 1 AS position,
         coalesce(sum(length(head || said) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
  FROM headed WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said))
SELECT conv_id, perspective, position::BIGINT AS position, turn, speaker, chat_role, rendered, char_start::BIGINT AS char_start,
       CASE WHEN chat_role = 'assistant' THEN (char_start + length(head))::BIGINT END AS loss_start,
       CASE WHEN chat_role = 'assistant' THEN (char_start + length(rendered) - 1)::BIGINT END AS loss_end
FROM placed
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).drop("target_uri")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, len(e) AS dim, list_dot_product(e, e) AS square FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(a.square * b.square) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reached r GROUP BY r.a
"""


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.col("record.text")
    return sharding.shard(docs, sharding.text_bytes(F.col("text")) + 1).select(
        F.col("record.doc_id").alias("doc_id"),
        (sharding.text_bytes(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: What CRC-32 does with each half byte, by its reflected polynomial.
_CRC_TABLE = [functools.reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), n) for n in range(16)]
OP12_SQL = rf"""
WITH said AS (
  SELECT 0 AS side, row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents
  UNION ALL SELECT 1, 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM benchmark),
met AS MATERIALIZED (SELECT side, n, unnest(words) AS word FROM said),
forms AS (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM met)),
halves AS (SELECT word, list_transform(range(1, length(code) + 1), lambda k: (instr('0123456789ABCDEF', substr(code, (CASE WHEN k % 2 = 1 THEN k + 1 ELSE k - 1 END)::INT, 1)) - 1)::BIGINT) AS parts FROM forms),
placed AS (SELECT word, xor(list_reduce(parts, lambda c, x: xor(c >> 4, ({_CRC_TABLE}::BIGINT[])[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM halves),
counts AS (SELECT bucket, count(*) FILTER (side = 1) AS t, count(*) FILTER (side = 0) AS s FROM met JOIN placed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(t), 0)::DOUBLE AS ts, coalesce(sum(s), 0)::DOUBLE AS ss FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (ts + 10000))))::BIGINT AS g FROM counts, sums),
weights AS (SELECT n, sum(g)::BIGINT AS weight FROM met JOIN placed USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY n),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM said LEFT JOIN weights USING (n) WHERE side = 0)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST)::BIGINT AS place FROM scored)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_perspective_rotation, op2_warc, op3_near_vectors, op4_best_fit_packing, op5_multi_index, op6_byte_bpe, op7_pii, op8_simhash, op9_toxicity, op10_sharding, op11_secrets, op12_importance, op13_whitening)
}
ORACLES = {"op1_perspective_rotation": OP1_SQL, "op2_warc": OP2_SQL, "op3_near_vectors": OP3_SQL, "op12_importance": OP12_SQL}
