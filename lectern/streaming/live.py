"""Structured Streaming forms of the job operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as T
from ..operators import chunkers as C
from ..operators.jobs import CURRENT_ACTIONS, parsed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def narrated(docs: DataFrame, target_minutes: float = 1.0, max_chars: int = 150) -> DataFrame:
    return C.chunk_sentences(C.split_sections(docs, target_minutes=target_minutes), max_chars=max_chars)


def resumable_pipeline(docs: DataFrame, sink: str, checkpoint: str, cut: Callable[[DataFrame], DataFrame] = narrated) -> StreamingQuery:
    """Cleans and cuts the documents that have come since the last run, and stops. A run that was cut
    short goes on where its checkpoint says, so nothing is done or written twice."""
    chunks = cut(docs.withColumn("text", T.universal_clean(F.col("text"))))
    return chunks.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def batch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a batch is written under its number and takes the place of what an
    earlier try of it wrote, so a batch that is run again after a failure stands once."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch_id={number}")


def run_to_end(df: DataFrame, folder: str, checkpoint: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Takes the stream in until nothing is left, batch by batch."""
    out = df.writeStream.foreachBatch(write or batch_writer(folder)).outputMode(mode).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, folder: str, schema: StructType, mode: str = "append") -> DataFrame:
    """What the batches wrote; of a complete result the newest holds."""
    rows = spark.read.schema(StructType([*schema, StructField("batch_id", LongType())])).parquet(folder)
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("batch_id").alias("batch_id")), "batch_id")
    return rows.select(*schema.names)


def live_section_state(events: DataFrame) -> DataFrame:
    """Current section and number of sections completed for each job, as checkpoints arrive (update
    mode). It takes maxima by ordinal, so late checkpoints change nothing but what they should."""
    p, action = parsed(events), F.col("action")
    moves = action.isin(*CURRENT_ACTIONS, "COMPLETE")
    return p.groupBy("job_id").agg(
        F.max_by(F.when(action == "COMPLETE", F.lit(None)).otherwise(F.col("section")), F.when(moves, F.col("ord"))).alias("current"),
        F.array_sort(F.collect_set(F.when(action == "COMPLETE", F.col("section")))).alias("completed"),
    )


class _Sections(StatefulProcessor):
    """Keeps of a job the section it is at, with the ordinal that told so, and the sections completed; all
    of it goes when the job ends, or after a time without checkpoints."""

    def __init__(self, end: str, idle_ms: int | None):
        self.end, self.idle_ms = end, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "ord bigint, section int", ttlDurationMs=self.idle_ms)
        self.done = handle.getMapState("done", "section int", "ord bigint", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.place.get() if self.place.exists() else None
        ended = False
        for batch in rows:
            ended = ended or bool((batch["type"] == self.end).any())
            known = batch[batch["section"].notna() & batch["action"].isin((*CURRENT_ACTIONS, "COMPLETE"))]
            if len(known):
                newest = known.loc[known["ord"].idxmax()]
                if at is None or newest["ord"] >= at[0]:
                    at = int(newest["ord"]), None if newest["action"] == "COMPLETE" else int(newest["section"])
            for section, order in known[known["action"] == "COMPLETE"].groupby("section")["ord"].max().items():
                self.done.updateValue((int(section),), (int(order),))
        completed = sorted(k[0] for k in self.done.keys()) if self.done.exists() else []
        if ended:
            self.place.clear()
            self.done.clear()
        elif at is not None:
            self.place.update(at)
        yield pd.DataFrame({"job_id": [key[0]], "current": pd.array([at[1] if at else None], dtype="Int32"), "completed": [completed], "ended": [ended]})

    def close(self) -> None:
        pass


def live_sections(events: DataFrame, end: str = "PIPELINE_COMPLETE", idle_ms: int | None = None) -> DataFrame:
    """As ``live_section_state``, a row for each job that a batch tells of (update mode), with ``ended``:
    whether the checkpoint ``end`` has come. Then the job's state is dropped, as it is after ``idle_ms``
    without a checkpoint if that is given; what comes later begins anew. Needs ``ROCKSDB``."""
    rows = parsed(events).select("job_id", "ord", "type", "section", "action")
    return rows.groupBy("job_id").transformWithStateInPandas(_Sections(end, idle_ms), outputStructType="job_id bigint, current int, completed array<int>, ended boolean", outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


class _LastSteps(StatefulProcessor):
    """Keeps the newest step times of a job, by ordinal, in list state, until nothing remains."""

    def __init__(self, kept: int = 3, idle_ms: int | None = None):
        self.kept, self.idle_ms = kept, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getListState("steps", "ord bigint, seconds double", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = [(int(o), float(s)) for o, s in self.steps.get()] if self.steps.exists() else []
        remaining = None
        for batch in rows:
            steps += [(int(o), float(s)) for o, s in zip(batch["ord"], batch["seconds"])]
            steps = sorted(steps)[-self.kept :]
            newest = batch.sort_values("ord").iloc[-1]
            if remaining is None or newest["ord"] >= remaining[0]:
                remaining = newest["ord"], newest["remaining"]
        if remaining[1] > 0:
            self.steps.put(steps)
        else:
            self.steps.clear()
        yield pd.DataFrame({"job_id": [key[0]], "ord": [steps[-1][0]], "eta_s": [sum(s for _, s in steps) / len(steps) * float(remaining[1])]})

    def close(self) -> None:
        pass


def live_eta(steps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Steps ``(job_id, ord, seconds, remaining)`` to the time left after each batch: the mean of the last
    three steps for what remains. The state of a job is dropped when nothing remains, or after ``idle_ms``
    without a step if that is given. The session must use the RocksDB state store (``ROCKSDB``)."""
    return steps.groupBy("job_id").transformWithStateInPandas(_LastSteps(idle_ms=idle_ms), outputStructType="job_id bigint, ord bigint, eta_s double", outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


def dedup_checkpoints(events: DataFrame, delay: str = "10 seconds", start: str = "PIPELINE_START", lateness: str = "1 day", block: str = "1 day", buckets: int = 256) -> DataFrame:
    """Without the start events of a job that come at most ``delay`` after another, dropped or not; all
    other events pass, and so do starts without a time. The result is the same for any number of batches
    in time order.

    Time is cut into slots a little longer than the delay: of a job's starts in a slot only the first can
    stay, and it does unless one of the slot before is near enough. A key is a ``block`` of slots and one of
    so many ``buckets`` of jobs, so the number of keys, each of which has its price in Python, grows with
    time and not with jobs. Of a job and slot a key keeps the first and last time, whatever the number of
    starts; the starts of a block's last slot go to the next block too, where only their time is kept. A
    block's state is dropped when the watermark, ``lateness`` behind the newest event, has passed it and a
    slot; starts that come still later are dropped with it.
    """
    within = int(pd.Timedelta(delay) / pd.Timedelta(microseconds=1))
    width = within + 1
    per_block = max(1, int(pd.Timedelta(block) / pd.Timedelta(microseconds=1)) // width)
    events = events.withWatermark("ts", lateness)
    begins = F.coalesce((F.col("type") == start) & F.col("ts").isNotNull(), F.lit(False))
    columns = events.columns

    def first_of_slots(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket, number = key
        seen = {(job, slot): (first, last) for job, slot, first, last in zip(*state.get)} if state.exists else {}
        kept, found = {}, []
        for rows in batches:
            rows = rows.sort_values(["_at", "ord"], kind="stable")
            jobs = rows["job_id"].tolist() if bucket >= 0 else [None] * len(rows)
            better = {}
            for place, (job, slot, at, order) in enumerate(zip(jobs, rows["_slot"].tolist(), rows["_at"].tolist(), rows["ord"].tolist())):
                first, last = seen.get((job, slot), (None, at))
                if slot // per_block == number:
                    if first is None or at < first or (at == first and (job, slot) in kept and order < kept[job, slot][0]):
                        kept[job, slot] = order, len(found), place
                        better[job, slot] = place
                        first = at
                seen[job, slot] = first, max(last, at)
            if better:
                for i, (which, place) in enumerate(better.items()):
                    kept[which] = kept[which][0], len(found), i
                found.append(rows.iloc[list(better.values())][columns])
        state.update(tuple(map(list, zip(*((job, slot, first, last) for (job, slot), (first, last) in seen.items())))))
        state.setTimeoutTimestamp(max(((int(number) + 1) * per_block + 1) * width // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        stay = [[] for _ in found]
        for (job, slot), (_, n, place) in kept.items():
            before = seen.get((job, slot - 1))
            if before is None or seen[job, slot][0] - before[1] > within:
                stay[n].append(place)
        for rows, places in zip(found, stay):
            if places:
                yield rows.iloc[places]

    slot, told = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / width).cast("bigint"), F.col("_slot")
    number = F.floor(told / per_block).cast("bigint")
    both = F.when(F.pmod(told, F.lit(per_block)) == per_block - 1, F.array(number, number + 1)).otherwise(F.array(number))
    bucket = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(buckets)))
    starts = events.filter(begins).select(*columns, F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), slot.alias("_slot"))
    dealt = starts.withColumn("_bucket", bucket.cast("int")).withColumn("_block", F.explode(both))
    job = events.schema["job_id"].dataType.simpleString()
    kept = dealt.groupBy("_bucket", "_block").applyInPandasWithState(first_of_slots, events.schema, f"jobs array<{job}>, slots array<bigint>, firsts array<bigint>, lasts array<bigint>", "append", "EventTimeTimeout")
    return events.filter(~begins).unionByName(kept)


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
