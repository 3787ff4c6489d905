"""Perspectives, archives, vectors, sharding, components and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import chat, components, multi_index, near_vectors, queries, sharding, warc
from lectern.llm.shared import join_told, new_folder
from tests.conftest import SF


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql)


# ---- perspectives --------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob lee", "hi\nthere"), (1, 2, "ann", None), (1, 3, None, "who"), (1, 3, None, "who"),
    (2, None, "ann", ""), (2, 5, "ann", "x" * 5000), (None, 1, "", "lost"), (3, 1, "system", "alone"),
]


def turns(spark, rows=TURNS):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, position int, perspective string")


@pytest.mark.parametrize("long", [4096, 2])
def test_perspectives_equal_sql(spark, long):
    got = chat.perspectives(turns(spark), long=long)
    names = got.columns
    want = by_duckdb(queries.OP1_SQL, conversations=turns(spark)).to_arrow_table().select(names).to_pylist()
    assert rows_of(got) == sorted((tuple(r.values()) for r in want), key=repr)
    text = "".join(r.rendered for r in sorted(got.collect(), key=lambda r: r.position) if (r.conv_id, r.perspective) == (1, "bob_lee"))
    own = [text[r.loss_start : r.loss_end] for r in got.collect() if (r.conv_id, r.perspective) == (1, "bob_lee") and r.loss_start is not None]
    assert own == ["hi\nthere<|im_end|>"]


def test_perspectives_long_dialogue(spark):
    rng = random.Random(1)
    made = turns(spark, [(7, rng.randrange(50), rng.choice("abc"), rng.choice(["yes", "no"])) for _ in range(900)])
    short, long = chat.perspectives(made), chat.perspectives(made, long=10)
    assert rows_of(short) == rows_of(long)


def test_perspectives_in_stretches_of_sampled_bounds(spark):
    """More rows than range bounds are drawn from, and no partitions laid together."""
    spoken = ["ann", "bob", "cy d", "system"]
    made = spark.range(0, 40_000, 1, 4).select(F.lit(7).cast("bigint").alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.element_at(F.array(*map(F.lit, spoken)), (1 + F.xxhash64("id") % 2 + F.col("id") % 2 + 1).cast("int")).alias("role"), F.repeat(F.lit("a"), (F.col("id") % 11).cast("int")).alias("text"))
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in keys}
    want = {tuple(r) for r in chat.perspectives(made, long=1_000_000).collect()}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in chat.perspectives(made).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (len(got), len(set(got) - want), len(want - set(got))) == (len(want), 0, 0)


@pytest.mark.parametrize("turns_made", [20_000, 100_000])
def test_long_dialogues_equal_sql(spark, turns_made):
    made = spark.range(0, turns_made, 1, 8).select(F.lit(3).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("").alias("role"), F.repeat(F.lit("w"), (F.col("id") % 7).cast("int")).alias("text"))
    made = made.withColumn("role", F.when(F.col("turn") % 3 == 0, "bob").otherwise("ann"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = chat.perspectives(made)
        want = by_duckdb(queries.OP1_SQL, conversations=made).to_arrow_table().select(got.columns)
        key = [("perspective", "ascending"), ("position", "ascending")]
        assert got.toArrow().sort_by(key).to_pylist() == want.sort_by(key).to_pylist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_perspectives_empty(spark):
    assert chat.perspectives(turns(spark).limit(0)).collect() == []


# ---- archives ------------------------------------------------------------------------------------


def pages(spark):
    big = "<p>" + "same words " * 200
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (2, "http://c", "short"), (9, "http://d", "short"), (4, "http://e", None), (6, "http://f", ""), (7, "http://g\r\nX: y", "é" * 700), (8, "u", "z" * 400_000), (5, "http://b", big)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, digest string, revisit int")


def test_archives_equal_sql(spark):
    got = warc.round_trip(spark, pages(spark)).drop("target_uri")
    want = by_duckdb(queries.OP2_SQL, pages=pages(spark)).to_arrow_table().select(got.columns).to_pylist()
    assert rows_of(got) == sorted((tuple(r.values()) for r in want), key=repr)


def test_archives_start_with_a_dictionary_and_hold_a_frame_a_record(spark):
    folder = new_folder(spark, "warc")
    rows = warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet"), folder, archive_bytes=50_000).collect()
    assert warc.read_archives(warc.archives_in(spark, folder)).count() == 50 and len(rows) > 1
    trained = 0
    for r in rows:
        raw = open(r.path.removeprefix("file:"), "rb").read()
        magic, size = np.frombuffer(raw[:8], "<u4").tolist()
        assert magic == 0x184D2A5D and len(raw) == r.length
        trained += size > 0
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size]) if size else None
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        headers, block = warc.parse_record(frame.decompress(raw[8 + size :]))
        assert headers["WARC-Type"] in ("response", "revisit") and frame.eof
        magic, size = np.frombuffer(raw[-8:], "<u4").tolist()
        assert magic == 0x184D2A50 and size == 0
    assert trained


def test_a_cut_archive_is_an_error():
    import io

    raw = b"".join(warc.archive([b"WARC/1.1\r\nA: b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"] * 3))
    assert len(list(warc.read_archive(io.BytesIO(raw), 7))) == 3
    assert len(list(warc.read_archive(io.BytesIO(raw + warc.END.encode()), 11))) == 3
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))


def test_archives_empty(spark):
    assert warc.round_trip(spark, pages(spark).limit(0)).collect() == []


# ---- vectors -------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, node bigint, cell int"


def vectors(spark, seed=1, n=260, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=dim) if i % 4 or not rows else np.asarray(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=dim) * rng.choice([0, 0.1, 0.35])
        rows.append((i, [float(np.float32(v)) for v in base], int(rng.integers(3))))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * dim, 1), (1003, [float("nan")] + [1.0] * (dim - 1), 1), (1004, [float("inf")] + [1.0] * (dim - 1), 1), (1005, [None] + [1.0] * (dim - 1), 1)]
    rows += [(1006, rows[5][1], None), (None, rows[5][1], 1), (1007, rows[5][1][:3], 1), (5, rows[5][1], rows[5][2])]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def slow_links(rows, threshold=0.93):
    n = len(rows)
    links, label = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if None in (a, b, p, q) or p != q or not finite(x) or not finite(y) or len(x) != len(y):
                continue
            x, y = np.asarray(x), np.asarray(y)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                s, t = label[i], label[j]
                label = [min(s, t) if c in (s, t) else c for c in label]
    least = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    return sorted(((r[0], k, least[c], r[0] is not None and r[0] == least[c]) for r, k, c in zip(rows, links, label)), key=repr)


@pytest.mark.parametrize(("block", "few"), [(1024, 100_000), (16, 0)])
def test_near_vectors_equal_brute_force(spark, block, few):
    rows, df = vectors(spark)
    assert rows_of(near_vectors.near_vectors(df, block=block, most_broadcast=few)) == slow_links(rows)


def test_near_vectors_equal_sql(spark):
    rows, _ = vectors(spark, seed=4)
    df = spark.createDataFrame([(i, v, c) for i, v, c in rows if i is not None and v and len(v) == 16][:-1], "vec_id bigint, embedding array<float>, label int")
    got = near_vectors.near_vectors(df)
    want = by_duckdb(queries.OP3_SQL, embeddings=df).to_arrow_table().select(got.columns).to_pylist()
    assert rows_of(got) == sorted((tuple(r.values()) for r in want), key=repr)
    assert sum(r[1] for r in rows_of(got)) > 0


def test_hot_keys_and_others_are_told_once(spark):
    rows = spark.createDataFrame([(i, i % 40 if i > 300 else 7) for i in range(600)], "id bigint, k bigint")
    told = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = join_told(rows, told, ["k"], "n", share=10)
    assert rows_of(got.select("id", "k", "most")) == rows_of(rows.join(told, "k").select("id", "k", "most"))


def test_zeros_of_both_signs_are_equal(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [-0.0, 1.0], 1), (3, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert rows_of(near_vectors.near_vectors(df)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_collision_count_is_calibrated():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * side
    i, j = near_vectors.block_links(a[:1000], b[:1000], 0.93)
    assert {(k, k) for k in range(1000)} <= set(zip(i.tolist(), j.tolist()))


def test_colliding_equals_plain_counts():
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(70, 64)), rng.normal(size=(130, 64))
    counts = (np.abs(q[:, None] - b[None]) <= 0.4).sum(2)
    assert (near_vectors.colliding(q, b, 0.4, 14) == (counts >= 14)).all()


def test_vectors_empty(spark):
    _, df = vectors(spark)
    assert near_vectors.near_vectors(df.limit(0)).collect() == []
    assert multi_index.search(df.limit(0)).collect() == []


def slow_nearest(rows, every, k=10):
    dim = 16
    use = [(i, np.asarray(v)) for i, v, _ in rows if i is not None and finite(v) and len(v) == dim]
    out = []
    for q, x in use:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in use if i != q)[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(near, 1)]
    return out


def test_multi_index_recall_and_scores(spark):
    rows, df = vectors(spark, n=900)
    got = [tuple(r) for r in multi_index.search(df, every=10).collect()]
    want = slow_nearest(rows, 10)
    assert len(got) == len(want)
    found = {(q, i) for q, _, i, _ in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want)
    at = {i: np.asarray(v) for i, v, _ in rows if i is not None and finite(v) and len(v) == 16}
    assert all(abs(np.sqrt(((at[q] - at[i]) ** 2).sum()) - s) < 1e-12 for q, _, i, s in got)
    for q in {g[0] for g in got}:
        ranked = sorted((g for g in got if g[0] == q), key=lambda g: g[1])
        assert [(s, i) for _, _, i, s in ranked] == sorted((s, i) for _, _, i, s in ranked)


def test_recall_with_part_of_the_entries_visited(spark):
    """On the largest table at hand, against brute force; entries visited are counted as well."""
    df = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in df.collect()]
    ids = np.asarray([r[0] for r in rows])
    x = np.asarray([r[1] for r in rows], "f8")
    index = multi_index.fit(x, len(x))
    got = {(r.query_id, r.vec_id) for r in multi_index.search(df, index=index).collect()}
    want = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        near = np.lexsort((ids, far))[:10]
        want += sum((int(ids[q]), int(ids[n])) in got for n in near)
    assert want >= 0.9 * 10 * (ids % 100 == 0).sum()
    assert index.part < 0.5


@pytest.mark.parametrize("block", [64, 8192])
def test_blocks_do_not_change_what_is_found(spark, block):
    rows = [(i, [float(i % 3), 1.0, float(i % 5), 2.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = multi_index.MultiIndex(np.asarray([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]]), np.asarray([[0.0, 2.0], [4.0, 2.0]]), 0.3)
    assert rows_of(multi_index.search(df, every=50, index=index, block=block)) == rows_of(multi_index.search(df, every=50, index=index, block=10_000))


def test_all_cells_are_visited_in_order():
    rng = np.random.default_rng(4)
    index = multi_index.MultiIndex(rng.normal(size=(5, 2)), rng.normal(size=(6, 2)))
    a, b = index.distances(rng.normal(size=(1, 4)))
    visited = list(index.visit(a[0], b[0], np.ones(30, int), 30))
    assert [s for _, s in visited] == sorted(a[0][c // 6] + b[0][c % 6] for c in range(30))
    assert sorted(c for c, _ in visited) == list(range(30)) and all(s == a[0][c // 6] + b[0][c % 6] for c, s in visited)
    assert index.reach(a[0], b[0], np.ones(30, int), 7) == visited[6][1]


def test_few_vectors_get_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id bigint, embedding array<float>")
    assert rows_of(multi_index.search(df)) == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(8**0.5))]


# ---- sharding ------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = [(i % 40, None if i % 7 == 0 else "" if i % 7 == 1 else "é" * i, "x", 1) for i in range(500)] + [(1, "big" * 100_000, "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bucket string, shard int")
    path = new_folder(spark, "in")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    for size in (1 << 24, 2000):
        got = sharding.shard(df, sharding.text_bytes(F.col("text")) + 1, bucket_bytes=size).collect()
        by_shard = {}
        for r in got:
            by_shard.setdefault(r.shard, []).append(r.slot)
        assert sorted(by_shard) == list(range(16))
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
        assert sorted(repr(tuple(r.record)) for r in got) == sorted(map(repr, rows))
    assert sharding.shard(df.limit(0), F.lit(1)).collect() == []


def test_sharding_depends_on_seed_and_rows_alone(spark):
    same = [(7, "copy", "x", 1)] * 40
    rows = [(i, f"text {i}" * (i % 9), "x", 1) for i in range(400)] + same
    made = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, width, few in ((1, 4, 1_000_000), (7, 8, 1_000_000), (40, 211, 0)):
            spark.conf.set("spark.sql.shuffle.partitions", str(width))
            df = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id bigint, text string, bucket string, shard int").repartition(parts)
            got = sharding.shard(df, sharding.text_bytes(F.col("text")) + 1, bucket_bytes=1500, most_broadcast=few, stretch=3)
            made.append({(r.shard, r.slot): tuple(r.record) for r in got.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] == made[2] and sorted(map(repr, made[0].values())) == sorted(map(repr, rows))
    other = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, bucket string, shard int"), F.lit(10), seed=11).collect()
    assert {(r.shard, r.slot): tuple(r.record) for r in other} != made[0]


def test_buckets_are_drawn_and_permuted(spark):
    """Each bucket holds the records whose hash says so, one bucket to a task, in the order of a
    Fisher-Yates shuffle of their drawn order."""
    df = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(600)], "doc_id bigint, text string")
    total = sum(i % 50 + 1 for i in range(600))
    buckets = -(-total // 2000)
    hashed = df.select("doc_id", F.xxhash64("doc_id", "text").alias("h"))
    drawn = lambda salt: F.xxhash64(F.lit(10), F.lit(salt), "h", F.lit(0).cast("bigint"))
    told = hashed.select("doc_id", drawn("order").alias("at"), F.pmod(drawn("bucket"), F.lit(buckets)).alias("bucket")).collect()
    spread = sharding.two_pass_shuffle(df, sharding.text_bytes(F.col("text")) + 1, bucket_bytes=2000)
    got = {}
    for r in spread.orderBy("bucket", "place").collect():
        got.setdefault(r.bucket, []).append(r.record.doc_id)
    assert set(got) <= set(range(buckets)) and len(got) > 3
    moved = 0
    for b, ids in got.items():
        order = [r.doc_id for r in sorted(told, key=lambda r: r["at"]) if r.bucket == b]
        assert sorted(order) == sorted(ids)
        # the same array through Spark's shuffle, in a task of the same number
        one = spark.range(0, buckets, 1, buckets).select(F.when(F.col("id") == b, F.array(*map(F.lit, order))).alias("x")).select(F.shuffle("x", 10).alias("y")).filter("y is not null")
        assert one.first()["y"] == ids
        moved += sum(x != y for x, y in zip(order, ids))
    assert moved > 400


def test_sharded_files_hold_every_record(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    path = new_folder(spark, "shards")
    sharding.write_shards(sharding.shard(df, sharding.text_bytes(F.col("text")) + 1), path)
    back = spark.read.parquet(path)
    assert back.select("shard_no").distinct().count() == 16
    assert rows_of(back.select("doc_id", "text")) == rows_of(df.select("doc_id", "text"))


def test_op10_columns(spark):
    for r in queries.op10_sharding(spark, SF).limit(20).collect():
        assert r.law == "rows" and r.grown_shard is None
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1 for r in queries.op10_sharding(spark, SF).collect())


# ---- components and the pipeline -----------------------------------------------------------------


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (9, None)]
    root = list(range(1100))
    for a, b in edges:
        if None not in (a, b):
            s, t = root[a], root[b]
            root = [min(s, t) if x in (s, t) else x for x in root]
    nodes = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()
    assert {(r.node, r.component) for r in got} == {(n, root[n]) for n in nodes} and len(got) == len(nodes)


def test_pipeline_equals_its_parts(spark):
    from tests.llm.test_text_operators import HF, check_packing, slow_fingerprint  # noqa: F401

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert clean.columns == docs.columns
    toxic = {r.doc_id for r in queries.op9_toxicity(spark, SF).collect() if r.toxic}
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()} - toxic
    path = new_folder(spark, "clean")
    clean.write.parquet(path)
    clean = spark.read.parquet(path)
    kept = corpus_pipeline.near_duplicate_stage(spark, clean, SF)
    assert kept.columns == docs.columns
    from lectern.llm import simhash

    want = {r.doc_id for r in simhash.near_duplicates(clean).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    safe = corpus_pipeline.personal_data_stage(spark, kept, SF)
    assert safe.columns == docs.columns and safe.count() == len(want)
    texts = [(r.doc_id, r.text) for r in safe.collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    check_packing(texts, got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


ODD_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, toxicity string, component string, length int"


def odd_input(spark, rows, labels):
    """A folder with the given documents and labels, with columns whose names the operators use."""
    folder = new_folder(spark, "odd")
    spark.createDataFrame([(*r, "en", "s", None if r[1] is None else len(r[1]), "r", "t", "c", 1) for r in rows], ODD_DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_on_odd_rows(spark):
    from tests.llm.test_text_operators import check_packing

    long = " ".join(f"word{i % 977} of {i}" for i in range(40_000))
    rng = random.Random(12)
    plain = [(100 + i, " ".join(f"w{rng.randrange(5000)}x" for _ in range(60))) for i in range(30)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, long), (5, "call +1 (415) 555-0132 or write a.b@example.com today"), (5, "another text with the same id, not alike"), (None, "no id has this one text here"), *plain, plain[0], (7, plain[1][1])]
    folder = odd_input(spark, rows, [(100 + i, 1, 0) for i in range(30)] + [(None, 1, 1), (1, None, None), (999, 0, 1)])
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, folder)
        assert out.columns == seen.columns, name
        path = new_folder(spark, name)
        out.write.parquet(path)
        seen = spark.read.parquet(path)
    kept = [(r.doc_id, r.text) for r in seen.collect()]
    # one of the texts without words, one of each group of copies, all others
    want = [(1, None), (4, long), (5, "call [PHONE] or write [EMAIL] today"), (5, rows[5][1]), (None, rows[6][1]), *[p for p in plain if p != plain[1]], (7, plain[1][1])]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    check_packing(kept, corpus_pipeline.run(spark, folder).collect())


def test_pipeline_of_nothing(spark):
    assert corpus_pipeline.run(spark, odd_input(spark, [], [])).collect() == []
