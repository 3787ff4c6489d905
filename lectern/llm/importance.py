"""Importance resampling towards a target distribution, by hashed n-grams.

Documents and target texts are bags of n-grams hashed into buckets. The gain of a bucket is the logarithm
of how much likelier it is in the target than in the documents; a document's weight is the sum of the
gains of its n-grams, and adding Gumbel noise to the weights and taking the largest draws documents without
replacement, each with odds that grow as the exponential of its weight. In a task, the n-grams of a batch
are interned in an open-addressed table (``ngram_table``), so that each distinct one is put in its bucket
once, and its occurrences gather the bucket's gain by the number of their slot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import numbered
from ..sources.scratch import stored
from .ngram_table import Table, parts
from .shared import slices

#: Buckets, words of the longest n-gram, words a document must have to be drawn, and the seed.
BUCKETS, ORDER, LEAST_WORDS, SEED = 10_000, 1, 20, "2024"
#: Bytes of text that are held at a time, and scored documents that one window ranks.
SLICE_BYTES, LONG = 4 << 20, 200_000


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def bucket_counts(df: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``(bucket, n)``: how many n-grams of all texts fall into each bucket that any does. A task gives
    one row a bucket at most, whatever it reads."""

    def tasks(batches):
        total = np.zeros(buckets, "i8")
        for b in batches:
            for part in slices(b, 0, SLICE_BYTES):
                for _, made in parts(_texts(part, 0), order):
                    met, n = Table(made, buckets).by_bucket()
                    total[met] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(tasks, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _filled(counts: DataFrame, buckets: int) -> list[int]:
    """Counts of all buckets: ``buckets`` numbers, whatever the input."""
    out = [0] * buckets
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains(target: list[int], source: list[int], scale: int = 1000) -> np.ndarray:
    """Of each bucket the logarithm of its smoothed share of the target over that of the source, in
    thousandths, floored."""
    t_all, s_all, k = float(sum(target)), float(sum(source)), len(target)
    return np.asarray([math.floor(scale * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for t, s in zip(map(float, target), map(float, source))], "i8")


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Rows ``(doc_id, n_features, words, weight)``, one for each row of ``docs``. No shuffle."""
    buckets = len(gain)

    def tasks(batches):
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                n, words, weight = (np.zeros(part.num_rows, "i8") for _ in range(3))
                for ids, made in parts(_texts(part, 1), order):
                    if ids:
                        count, total = Table(made, buckets).sums(gain, len(ids))
                        n[ids] += count
                        weight[ids] += total
                        words[ids] += made.words
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(words), pa.array(weight)], names=["doc_id", "n_features", "words", "weight"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id bigint, n_features bigint, words bigint, weight bigint")


def noise(doc_id: Column, seed: str = SEED, scale: int = 1000) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = 10, seed: str = SEED, long: int = LONG,
) -> DataFrame:
    """Rows ``(doc_id, n_features, weight, score, rank)``, one for each row of ``docs``.

    Of the documents with ``least_words`` words the given per cent (rounded down) are drawn, those with the
    highest scores, ties to the smaller doc_id; they are ranked from 1 in that order, others have a null
    rank. Words are runs of letters, digits and signs beyond ASCII, large A-Z read as small; an n-gram is
    counted as often as it stands.

    Null and empty texts have no n-grams and weight 0; very long ones are read whole, in parts between
    words. Repeated rows and repeated doc_ids are drawn as rows of their own; of rows with one doc_id and
    one score any comes first; a null doc_id has the noise of an empty one and comes first among equal
    scores. Without target texts all gains come from the documents alone; an empty table gives no rows.
    Other columns are not read. Documents are read twice and not shuffled; what is ranked are rows of five
    numbers, written once and put in order in stretches.
    """
    gain = gains(_filled(bucket_counts(target, target_col, order, buckets), buckets), _filled(bucket_counts(docs, text_col, order, buckets), buckets))
    scored = weighted(docs, gain, id_col, text_col, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    may = F.col("words") >= least_words
    drawn = scored.filter(may).count() * percent // 100
    ranked = numbered(scored.filter(may).withColumn("_serial", F.monotonically_increasing_id()), [], [F.desc("score"), F.asc("doc_id"), F.asc("_serial")], "rank", long)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint"))
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, "rank").unionByName(scored.filter(~may).select(*names, F.lit(None).cast("bigint").alias("rank")))
