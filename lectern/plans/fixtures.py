"""Inputs that Spark derives from the given tables, as SQL that Spark and an ANSI engine read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

#: Texts with references, notes, dashes and abbreviations put in, chosen by document.
NOISY = """
SELECT doc_id, lang, source, CASE CAST(doc_id % 9 AS INT)
  WHEN 0 THEN replace(text, ', ', ' [12], ')
  WHEN 1 THEN replace(text, ' the ', ' (3) the ')
  WHEN 2 THEN replace(replace(text, ' of ', ' — of – and - '), ' de ', ' - de – ')
  WHEN 3 THEN replace(replace(text, ' in ', ' Dr. in e.g.x etc. vs.y '), ' la ', ' i.e.z la Mrs.k ')
  WHEN 4 THEN replace(text, '. ', ' ! ?')
  WHEN 5 THEN replace(text, chr(10), chr(10) || '7. note here' || chr(10))
  WHEN 6 THEN replace(text, ' a ', ', 12, colonel 345. a don' || chr(39) || 't & niche@ ')
  WHEN 7 THEN replace(text, chr(10), chr(10) || chr(10))
  ELSE text END AS text
FROM documents
"""

#: Every line a paragraph of its own.
PARAGRAPHS = "SELECT doc_id, lang, source, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"

#: The events as checkpoints of jobs (a user's events are a job's).
CHECKPOINTS = """
SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord, CAST(ts AS TIMESTAMP) AS ts, event_id, value,
  CASE event_type WHEN 'signup' THEN 'PIPELINE_START'
    WHEN 'view' THEN 'SECTION_' || CAST(1 + event_id % 8 AS VARCHAR(10)) || '_START'
    WHEN 'click' THEN 'SECTION_' || CAST(1 + event_id % 8 AS VARCHAR(10)) || '_TTS_COMPLETE'
    WHEN 'purchase' THEN 'SECTION_' || CAST(1 + event_id % 8 AS VARCHAR(10)) || '_COMPLETE'
    ELSE 'SECTION_' || CAST(1 + event_id % 8 AS VARCHAR(10)) || '_TTS_FAILED' END AS type
FROM events
"""

#: Events as attempts at chunks: five chunks a job.
ATTEMPTS = """
SELECT user_id AS job_id, CAST(event_id % 5 AS INT) AS chunk_no, CAST(row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS INT) AS attempt,
  event_type <> 'error' AS ok FROM events
"""

#: Orders as sections of a customer's job, a hundred at most by key.
ORDER_SECTIONS = "SELECT o_custkey AS job_id, CAST(o_orderkey % 100 AS INT) AS section, o_orderstatus AS status, o_orderkey FROM orders"

#: Settings in two layers, from customers and their orders: a null value is a value.
CONFIG = """
SELECT c_custkey AS job_id, 0 AS layer, c_mktsegment AS section, 'balance' AS key, CAST(CAST(floor(c_acctbal) AS INT) AS VARCHAR(20)) AS value FROM customer
UNION ALL SELECT c_custkey, 0, c_mktsegment, 'nation', CAST(c_nationkey AS VARCHAR(20)) FROM customer
UNION ALL SELECT o_custkey, CAST(1 + o_orderkey % 1000000 AS INT), c_mktsegment, CASE WHEN o_orderkey % 3 = 0 THEN 'balance' ELSE 'priority' END,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END FROM orders JOIN customer ON o_custkey = c_custkey
"""

#: The same with ``place``, an order's key: equal layers of a job are resolved by it, where SQL leaves them open.
PLACED_CONFIG = """
SELECT c_custkey AS job_id, 0 AS layer, c_mktsegment AS section, 'balance' AS key, CAST(CAST(floor(c_acctbal) AS INT) AS VARCHAR(20)) AS value, CAST(0 AS BIGINT) AS place FROM customer
UNION ALL SELECT c_custkey, 0, c_mktsegment, 'nation', CAST(c_nationkey AS VARCHAR(20)), 0 FROM customer
UNION ALL SELECT o_custkey, CAST(1 + o_orderkey % 1000000 AS INT), c_mktsegment, CASE WHEN o_orderkey % 3 = 0 THEN 'balance' ELSE 'priority' END,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
"""

#: Vectors as short signals of ten samples a second.
SIGNALS = "SELECT vec_id, 10 AS rate, embedding AS samples, label FROM embeddings"


def derived(spark: SparkSession, sf_dir: str, sql: str, bounded: bool = True) -> DataFrame:
    """The rows of one of the statements above, over the tables of ``sf_dir``; ``bounded`` as in ``spread``."""
    tables = [t for t in ("documents", "events", "orders", "customer", "part", "lineitem", "embeddings", "conversations", "pages", "labels", "supplier", "nation", "benchmark") if f" {t}" in sql]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if sql in (NOISY, PARAGRAPHS):
        frames["documents"] = spread(frames["documents"], bounded)
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)
