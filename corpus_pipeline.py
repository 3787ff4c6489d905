"""A corpus pipeline of four stages: toxic documents go, one of each group of near-duplicates stays,
personal data is replaced, and what is left is packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import packing, pii, simhash, toxicity
from lectern.llm.shared import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; it is trained on the labelled ones.

    Null and empty texts are scored as texts without words, very long ones whole. Repeated rows and
    repeated or null ids stay or go by their own texts. A probability equal to the threshold goes. An
    empty table stays empty; without labels all stay. All columns are kept, whatever their names.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked, that with the smallest doc_id.

    Null, empty and blank texts have fingerprint zero, so one of them stays; very long texts are read
    whole. Null ids come last; of rows with the same smallest id one stays. An empty table stays empty.
    All columns are kept, whatever their names. ``docs`` must be a table that is read.
    """
    return simhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kinds, n_chars counted anew.

    Null and empty texts stay, with n_chars as it was for null ones; very long texts are replaced whole;
    of spans that overlap the first is replaced. Repeated rows stay, an empty table stays empty. All
    columns are kept, whatever their names.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence.

    Null and empty texts are a piece of the end id alone; very long texts are cut into as many pieces as
    they need. Repeated rows and repeated or null ids are packed as often as they stand; pieces of equal
    length take their places in the order of their parts and ids. An empty table gives no rows; other
    columns are not read.
    """
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), cache_entries=250_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Classifiers, fingerprints, a random field and tokenizers: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
