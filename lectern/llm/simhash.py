"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position gets a random non-zero vector of r+1 bits; each non-zero vector v of
r+1 bits makes a mask of the positions whose inner product with v is odd. Any r positions have some
v with which all their products are even, so two fingerprints that differ in at most r bits are
equal under that mask: every such pair meets in one of the 2^(r+1)-1 tables, none by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import Forest, components
from .shared import block_pairs, free_name, join_told, stored

#: Fingerprints of a bucket that are compared in one task; larger buckets are dealt as block pairs.
BLOCK = 2048


def cover_masks(radius: int, bits: int = 64, seed: int = 8) -> list[int]:
    """The masks. Vectors are dealt round-robin in a shuffled order, so that each mask keeps about
    half of the positions."""
    rng = np.random.default_rng(seed)
    vectors = 1 + rng.permutation(np.arange(bits) % (2 ** (radius + 1) - 1))
    return [sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 majority bits of the XXH64 hashes of the word shingles; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = np.zeros(n + 1, "i8")
    np.cumsum(np.fromiter(map(len, words), "i8", n) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), (starts[shingle:] - 1).tolist())], "<u8", n - shingle + 1)
    ones = np.zeros(64, "i8")
    for lo in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[lo : lo + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """Rows ``(doc_id, fp bigint)``, one for each row of ``docs``; no shuffle."""

    def tasks(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id bigint, fp bigint")


def _spanning(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs within ``radius`` connect: fewer than there are members,
    however many pairs there are. ``b``: pairs between two blocks only."""
    nodes = a if b is None else np.concatenate([a, b])
    right, shift = (a, 0) if b is None else (b, len(a))
    forest = Forest(len(nodes))
    for lo in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + 256, None] ^ right[None, :]) <= radius)
        forest.add(i + lo, j + shift)
    x, y = forest.ends()
    return nodes[x], nodes[y]


def _bucket_edges(radius: int):
    """For rows (table, bucket, part_a, part_b, side, fp) in that order: edges of each bucket part."""

    def of(rows: pa.Table):
        fp = rows.column("fp").to_numpy().view("<u8")
        side = rows.column("side").to_numpy()
        keys = [rows.column(c).to_numpy() for c in ("t", "bucket", "pa", "pb")]
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fp))
        for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            one, two = fp[lo:hi][side[lo:hi] == 0], fp[lo:hi][side[lo:hi] == 1]
            yield _spanning(one, two if keys[2][lo] != keys[3][lo] else None, radius)

    def tasks(batches):
        # a part ends before the next batch's first other key; what may go on is held back
        held: pa.Table | None = None

        def emit(rows: pa.Table):
            found = list(of(rows))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield from pa.table({"a": a.view("<i8"), "b": b.view("<i8")}).to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not len(rows):
                continue
            keys = [rows.column(c).to_numpy() for c in ("t", "bucket", "pa", "pb")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            yield from emit(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks()
        if held is not None:
            yield from emit(held)

    return tasks


def links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that connect exactly what the
    pairs within ``radius`` connect.

    Each fingerprint goes to every table under its mask. A bucket of more than ``block``
    fingerprints is dealt into parts by a hash, and every pair of parts is a unit of its own, so no
    bucket is gathered in one task; a unit returns a spanning forest, never all its pairs.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bucket")) for t, m in enumerate(cover_masks(radius))])
    keys = stored(prints.select("fp", F.explode(tables).alias("k")).select("k.t", "k.bucket", "fp"), "tables")
    sizes = keys.groupBy("t", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    n = F.ceil(F.col("size") / block).cast("int")
    met = keys.join(sizes, ["t", "bucket"]).withColumn("n", n).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = met.select("t", "bucket", "fp", F.explode(block_pairs(F.col("n"), F.col("p"))).alias("c")).select("t", "bucket", "c.pa", "c.pb", "c.side", "fp")
    units = dealt.repartition("t", "bucket", "pa", "pb").sortWithinPartitions("t", "bucket", "pa", "pb", "side", "fp")
    return units.mapInArrow(_bucket_edges(radius), "a bigint, b bigint").distinct()


def groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Rows ``(fp, copies, mark, component)`` for the distinct fingerprints of ``prints``, whose column
    ``mark`` (a struct that has an order and differs between fingerprints) stands for a row: the least
    mark of a fingerprint, and the least reachable. As marks are the nodes, no component is gathered
    to be named."""
    nodes = stored(prints.groupBy("fp").agg(F.count("*").alias("copies"), F.min("mark").alias("mark")), "nodes")
    end = lambda e: nodes.select(F.col("fp").alias(e), F.col("mark").alias(f"mark_{e}"))
    edges = links(nodes.select("fp"), radius).join(end("a"), "a").join(end("b"), "b")
    found = components(edges, "mark_a", "mark_b").withColumnRenamed("node", "mark")
    return nodes.join(found, "mark", "left").withColumn("component", F.coalesce("component", "mark"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one for each row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest doc_id reachable by links, itself included. Equal fingerprints stand for one node, so
    copies cost a row each and no pairs. Null, empty and blank texts have fingerprint zero and link
    like any other; very long texts are read whole, one at a time. Rows with a repeated doc_id are
    separate nodes with that id; a null doc_id is compared but never names a component (a component of
    null ids only has null). An empty table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    marked = prints.withColumn("mark", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "fp"))
    told = stored(groups(marked, radius).select("fp", "copies", F.col("component.id").alias("component_id")), "told")
    return join_told(prints, told, ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (null ids
    last), one of them if it is repeated. ``docs`` must be a table: rows are known by their places.

    Null, empty and blank texts have fingerprint zero and are a group; very long texts are read whole.
    All columns stay as they were, whatever their names; an empty table stays empty.
    """
    row = free_name(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    prints = stored(fingerprints(placed, row, text_col, shingle).withColumnRenamed("doc_id", row).join(placed.select(row, F.col(f"`{id_col}`").alias("id")), row), "prints")
    marked = prints.select("fp", F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("row")).alias("mark"))
    first = groups(marked, radius).filter(F.col("mark").eqNullSafe(F.col("component")))
    return placed.join(first.select(F.col("mark.row").alias(row)), row, "left_semi").drop(row)
