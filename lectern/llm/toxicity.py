"""Toxicity by a classifier chain.

The labelled categories, quality and then toxic, are predicted one after another by logistic
regressions on the counts of a small vocabulary of words and word beginnings (in inflected and
compounding languages a stem tells more than a word), chosen by how surprisingly often they stand in
toxic documents, and on the text's shape: its words, how many of them differ, their length and the share
of letters. Each model sees the probabilities of the categories before it. For training these are
out-of-fold, so a later model learns from predictions as uncertain as those it will meet.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import free_name, slices, stored

#: Words and beginnings of the chain's vocabulary, documents that one must occur in, and folds.
VOCABULARY, LEAST_DOCUMENTS, FOLDS = 128, 3, 5
#: Lengths of beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled documents used for fitting: those whose ids have the smallest hashes, so many at most.
TRAINING_ROWS = 10_000
THRESHOLD = 0.5
#: Bytes of text that are held as Python strings at a time in training.
SLICE_BYTES = 2 << 20
#: Columns of the labels, in the order of the chain.
CATEGORIES = ("quality", "toxic")
#: Features of a text's shape.
SHAPE = 4
_WORD = re.compile(r"[^\W\d_]+")


class Vocabulary:
    """Words, and beginnings written with a ``*`` after them."""

    def __init__(self, entries: list[str]):
        self.index = {w: i for i, w in enumerate(entries)}
        self.heads = {w.rstrip("*")[:4] for w in entries}

    def count(self, text: str | None) -> tuple[Counter, tuple[int, int, int, int]]:
        """How often each entry is met in the text; its words, different words, letters and characters."""
        text = text or ""
        words = _WORD.findall(text.lower())
        counts: Counter = Counter()
        get, heads = self.index.get, self.heads
        for w in words:
            if w[:4] in heads:
                for form in (w, *(f"{w[:n]}*" for n in BEGINNINGS if len(w) >= n)):
                    if (i := get(form)) is not None:
                        counts[i] += 1
        return counts, (len(words), len(set(words)), sum(map(len, words)), len(text))


def choose(candidates: list[tuple[str, int, int]], size: int) -> list[str]:
    """The first ``size`` of the ranked (entry, documents, toxic documents), without those that say no
    more than one chosen before: a longer form that is no more often toxic, or one of the same stem
    that is met in about as many documents."""
    chosen: dict[str, tuple[int, float]] = {}
    by_head: dict[str, list[str]] = {}
    for entry, documents, toxic in candidates:
        stem, rate = entry.rstrip("*"), toxic / documents
        kin = by_head.setdefault(stem[:4], [])
        longer = any(x.endswith("*") and stem.startswith(x[:-1]) and rate <= chosen[x][1] + 0.01 for x in kin)
        if not longer and all(abs(chosen[x][0] - documents) > 0.02 * documents for x in kin):
            chosen[entry] = documents, rate
            kin.append(entry)
            if len(chosen) == size:
                break
    return list(chosen)


def features(counted: list[tuple[Counter, tuple[int, int, int, int]]], width: int) -> np.ndarray:
    """Log counts of each entry of the vocabulary and of all of them, then the text's shape, whose
    shares are zero for a text without words."""
    x = np.zeros((len(counted), width + 1 + SHAPE))
    for row, (counts, (n, different, letters, chars)) in zip(x, counted):
        for i, c in counts.items():
            row[i] = np.log1p(c)
        row[width:] = np.log1p(sum(counts.values())), 0.1 * np.log1p(n), different / max(n, 1), letters / max(n, 1) / 10, letters / max(chars, 1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights, the bias last, by Newton steps; the bias is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    shrink[-1, -1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """For each row the probability that a model gives which was fitted on the labelled rows of other
    folds. ``y`` is 0 or 1, or nan where a label is missing."""
    out, told = np.zeros(len(x)), ~np.isnan(y)
    for f in np.unique(fold):
        here, learn = fold == f, (fold != f) & told
        w = logistic(x[learn], y[learn]) if learn.any() else logistic(x[told], y[told])
        out[here] = _sigmoid(np.column_stack([x[here], np.ones(here.sum())]) @ w)
    return out


@dataclass
class Chain:
    vocabulary: list[str]
    categories: tuple[str, ...] = CATEGORIES
    weights: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, labels: np.ndarray, folds: int = FOLDS, seed: int = 9) -> Chain:
        """``labels``: a column of 0, 1 or nan (not labelled) for each category, in the order of the
        chain. Rows without a category's label do not teach it but have its probability."""
        fold = np.random.default_rng(seed).integers(0, folds, len(x))
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            told = ~np.isnan(y)
            self.weights.append(logistic(x[told], y[told]))
            x = np.column_stack([x, out_of_fold(x, y, fold)])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w in self.weights:
            p = _sigmoid(np.column_stack([x, np.ones(len(x))]) @ w)
            out.append(p)
            x = np.column_stack([x, p])
        return np.column_stack(out)


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = CATEGORIES, vocabulary: int = VOCABULARY, rows: int = TRAINING_ROWS) -> Chain:
    """Fits the chain on documents with a label of its last category. A document labelled more than
    once has the greatest value of each label; null labels, null ids and null texts do not count. The
    driver gets the vocabulary and, for at most ``rows`` documents, the counts of its words."""
    told = labels.filter(F.col(categories[-1]).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array(*[F.max(c).cast("int") for c in categories]).alias("told"))
    # so many ids at most, so the documents are not shuffled to find theirs
    chosen_ids = F.broadcast(told.orderBy(F.xxhash64("id"), "id").limit(rows))
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(chosen_ids, "id")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stored(known.groupBy("id").agg(F.min("text").alias("text"), F.max("told").alias("told"), F.max(F.element_at("told", -1)).alias("toxic")), "labelled").repartition(width, "id")
    word = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    forms = F.flatten(F.array(word, *[_beginnings(word, n) for n in BEGINNINGS]))
    words = known.select("toxic", F.explode(F.array_distinct(forms)).alias("word")).filter("word <> ''")
    sums = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = sums["n"], sums["t"]
    by_word = words.groupBy("word").agg(F.count("*").alias("d"), F.sum("toxic").alias("p")).filter(F.col("d") >= LEAST_DOCUMENTS)
    surplus = F.col("p") - F.col("d") * F.lit(t / max(n, 1))
    chosen = by_word.orderBy(F.desc(surplus * F.abs(surplus) / (F.col("d") + 10)), F.length("word"), "word").limit(20 * vocabulary).collect()
    chain = Chain(choose([tuple(r) for r in chosen], vocabulary))
    known_words = Vocabulary(chain.vocabulary)

    def count(batches):
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                counted = [known_words.count(x) for x in part.column(1).to_pylist()]
                at, times = ([list(f(c)) for c, _ in counted] for f in (Counter.keys, Counter.values))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (at, times)), pa.array([m for _, m in counted], pa.list_(pa.int64()))], names=["told", "at", "times", "shape"])

    seen = known.select("told", "text").mapInArrow(count, "told array<int>, at array<int>, times array<int>, shape array<bigint>").toArrow().to_pylist()
    chain.categories = categories
    if not seen:
        chain.weights = [np.append(np.zeros(len(chain.vocabulary) + 1 + SHAPE + k), -30.0) for k in range(len(categories))]
        return chain
    # the order of tasks does not matter
    seen.sort(key=lambda r: (r["shape"], r["at"], r["times"], [-1 if t is None else t for t in r["told"]]))
    x = features([(Counter(dict(zip(r["at"], r["times"]))), tuple(r["shape"])) for r in seen], len(chain.vocabulary))
    return chain.fit(x, np.asarray([[np.nan if t is None else t > 0 for t in r["told"]] for r in seen], float))


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``toxicity``: a struct of the probability of each category. If ``docs``
    has a column of that name already, underscores are put before the new one. Null and empty texts
    are scored as texts without words, very long ones whole; repeated rows are scored as they stand;
    an empty table stays empty."""
    known = Vocabulary(chain.vocabulary)
    name = free_name(docs, "toxicity")
    kind = ", ".join(f"{c}: double" for c in chain.categories)

    @F.pandas_udf(f"struct<{kind}>")
    def predict(text):
        import pandas as pd

        p = chain.predict(features([known.count(t) for t in text], len(chain.vocabulary)))
        return pd.DataFrame(p, columns=list(chain.categories))

    return docs.withColumn(name, predict(F.col(f"`{text_col}`")))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classify`` would not call toxic, with all their columns, whatever
    their names. Null and empty texts are texts without words; very long ones are read whole; repeated
    rows stay or go together; a probability equal to the threshold goes; an empty table stays empty, and
    without any label all rows stay."""
    scored = score(docs, train(docs, labels, id_col, text_col), text_col)
    name = scored.columns[-1]
    return scored.filter(F.col(f"`{name}`.toxic") < threshold).drop(name)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(doc_id, p_quality, p_toxic, toxic)``, one for each row of ``docs``: toxic where the
    chain's last probability is at least ``threshold``, that value included.

    Null and empty texts are scored as texts without words; very long ones are read whole; repeated
    rows and repeated or null doc_ids are scored as they stand; no documents give no rows, and without
    any label nothing is toxic. Other columns are not read.
    """
    chain = train(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), chain)
    return scored.select("doc_id", *[F.col(f"toxicity.{c}").alias(f"p_{c}") for c in CATEGORIES], (F.col("toxicity.toxic") >= threshold).alias("toxic"))
