"""Importance resampling: the table against plain counting, the whole against SQL, odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import importance, ngram_table as N, queries
from tests.conftest import SF

COLUMNS = "doc_id bigint, text string, score double, rank string, weight int"


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def grams_of(text, order):
    w = words_of(text)
    return [b" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def some_texts(rng, n=40):
    bits = ["a", "B", "word", "Wörter", "中文", "x" * 40, "y" * 31, "z" * 32, " ", "  ", "\n", "_", ".", "7", "longerword", "longerwore"]
    return ["".join(rng.choices(bits, k=rng.randrange(0, 60))).encode() for _ in range(n)]


def test_hash_is_xxh64():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    start = np.asarray([rng.randrange(4000) for _ in range(3000)])
    length = np.asarray([rng.randrange(1, 100) for _ in range(3000)])
    got = N.xxh64(raw, start, length)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + n]) for a, n in zip(start, length)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_features_and_slots(order):
    rng = random.Random(order)
    texts = some_texts(rng)
    made = N.features(b"".join(texts), np.cumsum([len(t) for t in texts]), order)
    got = [made.raw[a : a + n] for a, n in zip(made.start.tolist(), made.length.tolist())]
    for i, t in enumerate(texts):
        assert Counter(g for g, k in zip(got, made.text.tolist()) if k == i) == Counter(grams_of(t, order))
        assert made.words[i] == len(words_of(t))
    table = N.Table(made, 50)
    seen = {}
    for g, slot in zip(got, table.slots.tolist()):
        assert seen.setdefault(slot, g) == g
    assert len(seen) == len(set(got))
    for slot, g in seen.items():
        assert table.bucket[slot] == zlib.crc32(g) % 50 and table.count[slot] == got.count(g)
    gain = np.arange(50) - 20
    count, total = table.sums(gain, len(texts))
    assert total.tolist() == [sum(zlib.crc32(g) % 50 - 20 for g in grams_of(t, order)) for t in texts]
    assert count.tolist() == [len(grams_of(t, order)) for t in texts]


@pytest.mark.parametrize("keys", [lambda h: h * np.uint64(0), lambda h: h & np.uint64(3)])
def test_equal_keys_are_told_apart_by_their_bytes(keys):
    texts = some_texts(random.Random(9))
    made = N.features(b"".join(texts), np.cumsum([len(t) for t in texts]), 2)
    table = N.Table(made, 50, keys(N.xxh64(made.raw, made.start, made.length)))
    got = [made.raw[a : a + n] for a, n in zip(made.start.tolist(), made.length.tolist())]
    assert len({*zip(table.slots.tolist(), got)}) == len(set(got)) == len(set(table.slots.tolist()))


def test_table_grows():
    text = b" ".join(b"%d" % (i % 150_000) for i in range(400_000))
    made = N.features(text, np.asarray([len(text)]))
    table = N.Table(made, 10_000)
    assert table.used == 150_000 and table.count.sum() == 400_000 and len(table.owner) >= 2 * table.used
    met, n = table.by_bucket()
    want = Counter(zlib.crc32(b"%d" % (i % 150_000)) % 10_000 for i in range(400_000))
    assert dict(zip(met.tolist(), n.tolist())) == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_long_texts_come_in_parts(order):
    rng = random.Random(order + 10)
    texts = some_texts(rng, 12) + [b"", b"q" * 500 + b" tail", b" " * 300]
    count, words = [Counter() for _ in texts], [0] * len(texts)
    for ids, made in N.parts(texts, order, most=64):
        for a, n, k in zip(made.start.tolist(), made.length.tolist(), made.text.tolist()):
            count[ids[k]][made.raw[a : a + n]] += 1
        for i, n in zip(ids, made.words.tolist()):
            words[i] += n
    assert count == [Counter(grams_of(t, order)) for t in texts]
    assert words == [len(words_of(t)) for t in texts]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_sql(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.execute(queries.OP12_SQL).fetchall(), key=repr)


ROWS = [(1, None), (2, ""), (3, " .\n"), (None, "nobody " * 30), (4, "Same words here " * 10), (4, "Same words here " * 10), (5, "short one"), (6, "é中👍 " * 25), (7, "x" * 4_000), (8, "many different words " * 20_000), *((100 + i, f"alpha beta gamma{i % 7} " * 9) for i in range(60))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r", 1) for i, t in rows], COLUMNS)


@pytest.mark.parametrize("long", [10_000, 7])
def test_resample_equals_sql(spark, long):
    docs, target = frame(spark, ROWS), spark.createDataFrame([("gamma3 same", 1), (None, 2), ("Gamma3 words", 3)], "text string, doc_id int")
    got = importance.resample(docs, target, long=long)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == by_sql(documents=docs, benchmark=target)


def test_resample_of_empty_tables(spark):
    docs, target = frame(spark, ROWS), spark.createDataFrame([], "text string")
    assert rows_of(importance.resample(docs, target)) == by_sql(documents=docs, benchmark=target)
    assert importance.resample(docs.limit(0), target).collect() == []


def test_query_equals_sql(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = rows_of(queries.QUERIES["op12_importance"](spark, sf))
    assert got == by_sql(documents=spark.read.parquet(f"{sf}/documents.parquet"), benchmark=spark.read.parquet(f"{sf}/benchmark.parquet"))


def test_longer_runs_draw_towards_the_target(spark):
    rng = random.Random(4)
    docs = frame(spark, [(i, " ".join(rng.choices("sun moon star sky".split() if i % 10 == 0 else "iron rust bolt nut".split(), k=40))) for i in range(400)])
    target = spark.createDataFrame([("moon star sun sky moon sun",)], "text string")
    drawn = [r.doc_id for r in importance.resample(docs, target, order=3).filter(F.col("rank").isNotNull()).collect()]
    assert len(drawn) == 40 and sum(i % 10 == 0 for i in drawn) >= 38
