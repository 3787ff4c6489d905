"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records over buckets that fit in memory, by seeded hashes of what they hold and, for
equal records, of a running number, so that copies and hot keys spread like any others. Pass two
gathers each bucket in a task of its own, puts its records in the order of a seeded hash, permutes them
with Spark's ``shuffle`` (a Fisher-Yates shuffle of an array, seeded by the task's number, which is the
bucket's) and writes it. The buckets after one another are a permutation of the records that depends on
the seed and the records alone, not on how they were laid out or how many tasks there are; shards are
equal stretches of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free_name, stored

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Buckets whose starts (24 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Copies of a record, and buckets, that are counted through in one row or group.
STRETCH = 1 << 16


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _named(df: DataFrame) -> tuple[list[Column], str, str]:
    return [F.col(f"`{c}`") for c in df.columns], free_name(df, "hash"), free_name(df, "serial")


def with_serials(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``df`` with a hash of each row and, last, a number that tells equal rows apart. Rows whose hash
    is alone stay where they are; repeated rows are counted, not gathered, and counted out again."""
    columns, hashed, serial = _named(df)
    rows = df.withColumn(hashed, F.xxhash64(*columns))
    repeated = rows.groupBy(hashed).agg(F.count("*").alias("n")).filter("n > 1").select(hashed)
    if repeated.isEmpty():
        return rows.withColumn(serial, F.lit(0).cast("bigint"))
    n, block = free_name(df, "n"), free_name(df, "block")
    alone = rows.join(repeated, hashed, "left_anti").withColumn(serial, F.lit(0).cast("bigint"))
    counted = rows.join(repeated, hashed, "left_semi").groupBy(*columns, F.col(hashed)).agg(F.count("*").alias(n))
    # a record with very many copies is counted out by more than one task
    blocks = counted.withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1, F.lit(stretch).cast("bigint")))).repartition(F.xxhash64(hashed, block))
    told = blocks.withColumn(serial, F.explode(F.sequence(F.col(block), F.least(F.col(block) + stretch, F.col(n)) - 1)))
    return alone.unionByName(told.select(*columns, hashed, serial))


def two_pass_shuffle(df: DataFrame, size: Column, seed: int = 10, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows ``(bucket, place, record)``: ``record`` is a struct of all columns of ``df``, and
    ``(bucket, place)`` its place in the permutation. ``size``: a record's bytes."""
    total = df.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(-(-total // bucket_bytes), 1)
    columns, hashed, serial = _named(df)
    drawn = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col(hashed), F.col(serial))
    numbered = with_serials(df).select(F.struct(*columns).alias("record"), drawn("order").alias("at"), F.pmod(drawn("bucket"), F.lit(buckets)).cast("int").alias("bucket"))
    # bucket b is partition b: one to a task
    gathered = numbered.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("at", "record")).alias("records"))
    mixed = F.shuffle(F.transform(F.array_sort("records"), lambda r: r["record"]), seed)
    return stored(gathered.select("bucket", F.posexplode(mixed).alias("place", "record")), "buckets")


def shard(df: DataFrame, size: Column, shards: int = 16, seed: int = 10, bucket_bytes: int = BUCKET_BYTES, most_broadcast: int = MOST_BROADCAST, stretch: int = STRETCH) -> DataFrame:
    """Rows ``(shard, slot, record)``, one for each row of ``df``: shards 0..shards-1 whose numbers of
    rows differ by one at most, slots from 0 without gaps. Seed and rows decide which is where.

    ``record`` keeps all columns under their names, whatever they are, but they must be of kinds that
    can be compared. Nulls, empty and very long texts are records like any other; repeated rows are
    told apart by a running number, so any share of the rows may be equal; ties of the drawn order are
    broken by the record; an empty table gives no rows.
    """
    spread = two_pass_shuffle(df, size, seed, bucket_bytes)
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"bucket div {stretch}"))
    within = W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # a row for so many buckets each: few, however many records there are
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(W.orderBy("block")) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy()).alias("rows"))
    starts = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block").select("bucket", (F.col("before") + F.col("inner")).alias("first"), "rows")
    # broadcast while its size is sure: then no record is shuffled again
    few = spread.select("bucket").distinct().count() <= most_broadcast
    at = spread.join(F.broadcast(starts) if few else starts, "bucket").withColumn("at", F.col("first") + F.col("place"))
    at = at.withColumn("shard", F.expr(f"cast(at * {shards} div rows as int)"))
    return at.select("shard", F.expr(f"at - (shard * rows + {shards - 1}) div {shards}").alias("slot"), "record")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, with the records in the order of their slots in each file."""
    sharded.select("record.*", F.col("shard").alias("shard_no"), F.col("slot").alias("slot_no")).sortWithinPartitions("shard_no", "slot_no").write.partitionBy("shard_no").parquet(path)
