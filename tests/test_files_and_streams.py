"""Files that the tests write, and streams that must equal their batch forms."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions import signal as G
from lectern.operators import enrich, jobs, joins
from lectern.sources import files as S, log as logs
from lectern.streaming import live


def test_texts_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(" né ".encode())
    (tmp_path / "b.txt").write_bytes("né".encode("latin-1"))
    assert sorted(r.text for r in S.read_text_corpus(spark, str(tmp_path)).collect()) == ["né", "né"]


def test_progress_logs(spark, tmp_path):
    log = {"sections": {"total": 2}, "phases": {"preprocessing": {"complete": True}}, "checkpoints": [{"timestamp": "2024-01-01T00:00:00", "type": "PIPELINE_START", "message": "m"}, {"timestamp": "x", "type": "SECTION_1_START", "message": None}]}
    (tmp_path / "p.json").write_text(json.dumps(log, indent=1))
    (tmp_path / "bad.json").write_text("{ not json")
    rows = S.read_progress_logs(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.type) for r in rows] == [(0, "PIPELINE_START"), (1, "SECTION_1_START")]
    needing = S.jobs_needing_preprocessing(S.read_progress(spark, str(tmp_path / "p.json")))
    assert needing.count() == 0


def test_assets_and_pairs(spark, tmp_path):
    for name in ("B.WAV", "a.mp3", "c.doc", "a.txt"):
        (tmp_path / name).write_bytes(b"12")
    found = S.scan_assets(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["a.mp3", "B.WAV"]
    audio = found.withColumn("dir", F.lit("d"))
    texts = spark.createDataFrame([("d", "a", " said ")], "dir string, stem string, text string")
    assert [(r.stem, r.text) for r in joins.pair_samples(audio, texts).collect()] == [("a", "said")]
    assert sorted(r.text for r in joins.pair_samples(audio, texts, keep_unmatched=True).collect()) == ["", "said"]
    assert [r.stem for r in joins.unmatched_samples(audio, texts).collect()] == ["B"]


def test_config_snapshots(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"bark": {"voice": None, "temp": 0.7}, "metadata": {"engine": "bark"}}))
    rows = {(r.section, r.key): r.value for r in S.read_config_snapshots(spark, str(tmp_path)).collect()}
    assert rows == {("bark", "voice"): None, ("bark", "temp"): "0.7", ("metadata", "engine"): "bark"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, section_no int, text string")
    S.write_clean_text(df, str(tmp_path / "clean"))
    S.write_sections(df, str(tmp_path / "sections"))
    assert [tuple(r) for r in S.read_sections(spark, str(tmp_path / "sections"), "doc_id int, section_no int, text string").orderBy("section_no").collect()] == [(1, 1, "a", "section_001.txt"), (1, 2, "b", "section_002.txt")]
    log = spark.createDataFrame([(1, 0, "t", "PIPELINE_START", "m")], "job_id int, ord int, timestamp string, type string, message string")
    for _ in range(2):
        logs.append_checkpoints(log, str(tmp_path / "log"))
    assert logs.read_checkpoints(spark, str(tmp_path / "log")).count() == 2
    parts = spark.createDataFrame([(1, 1, " "), (2, 1, "a")], "doc int, ord int, text string")
    assert [r.doc for r in S.rejected_documents(parts, "doc", "text").collect()] == [1]


def test_a_request_past_the_end_is_an_error(spark):
    parts = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc int, part int")
    asked = lambda *rows: spark.createDataFrame([(*r, 0) for r in rows], "doc int, ordinal int, request_pos int")
    assert sorted((r.doc, r.part) for r in S.select_ordinals(parts, asked((1, 2), (2, 1), (1, 0)), "doc", "part", strict=True).collect()) == [(1, 2), (2, 1)]
    for bad in ((1, 3), (3, 1)):
        with pytest.raises(Exception, match="is not there"):
            S.select_ordinals(parts, asked((1, 1), bad), "doc", "part", strict=True).collect()


def test_numbers_are_chapters_or_pages(spark):
    pages = spark.createDataFrame([(b, p) for b in (1, 2, 3) for p in range(1, 11)], "book int, page_no int")
    chapters = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 5, 10), (2, 1, 1, 10)], "book int, number int, start_page int, end_page int")
    wanted = spark.createDataFrame([(1, 2), (2, 2), (3, 7)], "book int, number int")
    got = joins.pages_wanted(pages, chapters, wanted)
    assert sorted((r.book, r.page_no) for r in got.collect()) == [*((1, p) for p in range(5, 11)), (2, 2), (3, 7)]


def test_estimates_by_job_do_not_depend_on_batches(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from lectern.plans import stream_queries

    steps = spark.range(40).selectExpr("id % 3 AS job_id", "id AS ord", "id * 1.5D AS seconds", "50 - id AS remaining")
    for i in range(4):
        steps.filter(f"ord div 10 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema("job_id bigint, ord bigint, seconds double, remaining bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "steps"))
    rows = stream_queries._newest(stream_queries._drained(live.live_eta(stream), "update")).collect()
    want = {j: (max(o for o in range(40) if o % 3 == j)) for j in range(3)}
    assert {r.job_id: r.ord for r in rows} == want and len(rows) == 3
    for r in rows:
        last = [o * 1.5 for o in range(40) if o % 3 == r.job_id][-3:]
        assert r.eta_s == pytest.approx(sum(last) / 3 * (50 - want[r.job_id]))


def test_starts_far_apart_are_kept(spark, tmp_path):
    made = spark.createDataFrame([(1, 0, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 00:00:01"), (1, 2, "2024-01-20 00:00:00")], "job_id bigint, ord bigint, at string").selectExpr("job_id", "ord", "CAST(at AS TIMESTAMP) AS ts", "'PIPELINE_START' AS type", "'m' AS message")
    made.coalesce(1).write.parquet(str(tmp_path / "events"))
    kept = drain(live.dedup_checkpoints(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events"))), "far_apart", "append")
    assert sorted(r.ord for r in kept.collect()) == [0, 2]


def test_series_are_laid_end_to_end(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0], 10), ("a", 2, [3.0], 10), ("b", 1, [4.0], 10)], "s string, n int, samples array<float>, rate int")
    rows = {(r.s, r.n): (r.offset, r.samples) for r in G.concat_with_gaps(df, "s", "n").collect()}
    assert rows == {("a", 1): (0, [1.0, 2.0, 0.0, 0.0, 0.0]), ("a", 2): (5, [3.0]), ("b", 1): (0, [4.0])}


def test_artifacts_by_line(spark):
    df = spark.createDataFrame([("Page 3\nreal text\n12\nab\nmore text",), ("p. 4",)], "text string")
    assert [r.text for r in S.page_artifact_filter(df, mode="line").collect()] == ["real text more text"]


def test_enrich_retries(spark):
    def make():
        seen = {}

        def call(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "raises" or (text == "second" and seen[text] < 2):
                raise ValueError("no")
            return None if text == "none" else float(len(text))

        return call

    df = spark.createDataFrame([("fine",), ("second",), ("raises",), ("none",)], "text string").coalesce(1)
    got = {r.text: r for r in enrich.enrich_chunks(df, make).collect()}
    assert [(got[t].success, got[t].attempts) for t in ("fine", "second", "raises", "none")] == [(True, 1), (True, 2), (False, 3), (False, 3)]
    assert got["raises"].error == "ValueError: no" and got["none"].error == "no result"
    gated = enrich.enrich_chunks(df.filter("text = 'fine'"), make, accept=lambda text, payload: False).first()
    assert (gated.success, gated.attempts) == (True, 3)


EVENTS = "job_id bigint, ord bigint, ts timestamp, type string, message string"


@pytest.fixture
def events(spark, tmp_path):
    kinds = ["PIPELINE_START", "PIPELINE_START", "SECTION_1_START", "SECTION_1_TTS_COMPLETE", "SECTION_1_COMPLETE", "SECTION_2_START", "SECTION_x_START"]
    made = spark.range(21).select((F.col("id") % 3).alias("job_id"), F.floor(F.col("id") / 3).alias("ord"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.element_at(F.array(*map(F.lit, kinds)), (F.floor(F.col("id") / 3) + 1).cast("int")).alias("type"), F.lit("m").alias("message"))
    for i in range(3):
        made.filter(f"ord % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_live_section_state_equals_batch(spark, events):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(events)
    live_rows = drain(live.live_section_state(stream), "state", "complete")
    totals = spark.range(3).select(F.col("id").alias("job_id"), F.lit(2).alias("total"))
    batch = jobs.section_state(spark.read.parquet(events), totals)
    assert {(r.job_id, r.current, tuple(r.completed)) for r in live_rows.collect()} == {(r.job_id, r.current, tuple(r.completed)) for r in batch.collect()} == {(j, 2, (1,)) for j in range(3)}


def test_repeated_starts_are_dropped(spark, events):
    stream = spark.readStream.schema(EVENTS).parquet(events)
    kept = drain(live.dedup_checkpoints(stream), "starts", "append")
    assert kept.filter("type = 'PIPELINE_START'").count() == 3 and kept.count() == 18


@pytest.mark.parametrize("files", [1, 3])
def test_later_starts_are_kept(spark, tmp_path, files):
    seconds = [0, 4, 10, 21, 31, 42, 42]
    rows = [(j, i, 1_700_000_000 + s, "PIPELINE_START", "m") for j in (1, 2) for i, s in enumerate(seconds)] + [(1, 9, 1_700_000_001, "SECTION_1_START", "m")] * 2
    made = spark.createDataFrame(rows, "job_id bigint, ord bigint, at bigint, type string, message string").selectExpr("job_id", "ord", "timestamp_seconds(at) AS ts", "type", "message")
    for i in range(files):
        made.filter(f"ord * {files} div 10 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    kept = drain(live.dedup_checkpoints(stream), f"later_starts_{files}", "append")
    assert sorted((r.job_id, r.ord) for r in kept.collect()) == [(1, 0), (1, 3), (1, 5), (1, 9), (1, 9), (2, 0), (2, 3), (2, 5)]


def test_live_eta_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    steps = spark.range(20).select((F.col("id") % 2).alias("job_id"), F.floor(F.col("id") / 2).alias("ord"), (F.col("id") * 1.5).alias("seconds"), (20 - F.floor(F.col("id") / 2)).alias("remaining"))
    for i in range(2):
        steps.filter(f"ord div 5 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema("job_id bigint, ord bigint, seconds double, remaining bigint").parquet(str(tmp_path / "steps"))
    last = {r.job_id: r.eta_s for r in drain(live.live_eta(stream), "eta", "update").orderBy("ord").collect()}
    batch = jobs.rolling_eta(steps, F.col("remaining")).filter("ord = 9")
    assert last == {r.job_id: pytest.approx(r.eta_s) for r in batch.collect()}


def test_resumable_pipeline_does_each_document_once(spark, tmp_path):
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(i, "One sentence here. Another one [3] there. " * 40) for i in range(4)], schema)
    docs.filter("doc_id < 2").write.parquet(str(tmp_path / "in"))
    where = (str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    for more in (None, docs.filter("doc_id >= 2"), None):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        live.resumable_pipeline(live.file_stream(spark, str(tmp_path / "in"), schema), *where).awaitTermination(120)
    out = spark.read.parquet(where[0])
    per_doc = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(per_doc) == {0, 1, 2, 3} and len(set(per_doc.values())) == 1


def test_generation_and_rewind_edges(spark):
    one = spark.createDataFrame([(1, 0, "PIPELINE_START")], "job_id int, ord int, type string")
    assert [r.removed for r in jobs.rewind(one, F.lit(0)).collect()] == [0]
    ranges = spark.createDataFrame([("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 5), ("b", 6)], "k string, n int")
    assert {r.k: r.batch for r in jobs.compact_ranges(ranges, "k", "n").collect()} == {"a": "batch4", "b": "batch1-3_5-6"}
    with pytest.raises(Exception, match="missing configuration"):
        spark.range(1).select(jobs.config_value(F.lit('{"a": {}}'), "a.b", required=True)).collect()


def test_a_log_of_a_thousand_files_is_read_as_few(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = lambda a, b: spark.range(a, b, 1, 1).selectExpr("id % 3 AS job_id", "id AS ord", "'t' AS timestamp", "'x' AS type", "CAST(id AS STRING) AS message")
    lines(0, 1000).write.option("maxRecordsPerFile", 1).json(f"{path}/tail")
    assert len(logs.read_checkpoints(spark, path).inputFiles()) == 1000
    assert logs.compact_checkpoints(spark, path) == 1
    logs.append_checkpoints(lines(1000, 1010), path)
    read = logs.read_checkpoints(spark, path)
    assert len(read.inputFiles()) <= 4 and sorted(r.ord for r in read.collect()) == list(range(1010))
    assert logs.compact_checkpoints(spark, path, file_rows=600) == 2 and len(logs.read_checkpoints(spark, path).inputFiles()) <= 3
    assert sorted(r.ord for r in logs.read_checkpoints(spark, path).collect()) == list(range(1010))
    assert logs.read_checkpoints(spark, str(tmp_path / "none")).collect() == [] and logs.compact_checkpoints(spark, str(tmp_path / "none")) == 0


@pytest.mark.parametrize("stage", ["before the list", "before deleting"])
def test_a_compaction_cut_short_changes_nothing(spark, tmp_path, stage):
    import shutil

    path = tmp_path / "log"
    for i in range(3):
        logs.append_checkpoints(spark.createDataFrame([(1, i, "t", "x", "m")], logs.CHECKPOINTS), str(path))
    shutil.copytree(path / "tail", tmp_path / "kept")
    logs.compact_checkpoints(spark, str(path))
    shutil.rmtree(path / "tail")
    shutil.copytree(tmp_path / "kept", path / "tail")
    if stage == "before the list":
        shutil.rmtree(path / "listed-1")
    logs.append_checkpoints(spark.createDataFrame([(1, 9, "t", "x", "m")], logs.CHECKPOINTS), str(path))
    for _ in range(2):
        assert sorted(r.ord for r in logs.read_checkpoints(spark, str(path)).collect()) == [0, 1, 2, 9]
        logs.compact_checkpoints(spark, str(path))


def test_a_batch_that_fails_after_its_write_stands_once(spark, tmp_path):
    where, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10, 1, 1).write.mode("append").parquet(where)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(where)
    write, failed = live.batch_writer(out), []

    def once(batch, number):
        write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        live.run_to_end(stream, out, at, write=once)
    live.run_to_end(stream, out, at, write=once)
    assert failed == [1] and sorted(r.id for r in live.read_batches(spark, out, stream.schema).collect()) == list(range(30))


def test_ended_calls_are_not_made_again(spark, tmp_path):
    """A task dies in the first run; the second calls for its chunks alone, and for failed ones if asked."""
    log, seen, poison = str(tmp_path / "log"), tmp_path / "seen", tmp_path / "poison"
    seen.mkdir()
    poison.write_text("")

    def make():
        import os
        import time
        import uuid

        def call(text):
            if text == "c13" and poison.exists():
                time.sleep(3)
                os._exit(1)
            (seen / f"{text}-{uuid.uuid4().hex}").write_text("")
            return None if text == "c5" else float(len(text))

        return call

    df = spark.range(40).selectExpr("id", "concat('c', id) AS text", "id * 2 AS more")
    with pytest.raises(Exception):
        enrich.enrich_once(df, make, log, "id", chunks_per_task=4, retry_attempts=1).collect()
    ended = {r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(log).collect()}
    poison.unlink()
    got = enrich.enrich_once(df, make, log, "id", chunks_per_task=4, retry_attempts=1).collect()
    made = lambda: Counter(p.name.partition("-")[0] for p in seen.iterdir())
    assert len(got) == 40 and all(r.success == (r.id != 5) and r.more == 2 * r.id for r in got)
    assert len(ended) >= 4 and all(made()[f"c{i}"] == 1 for i in ended) and set(made()) == {f"c{i}" for i in range(40)}
    before = sum(made().values())
    assert len(enrich.enrich_once(df, make, log, "id").collect()) == 40 and sum(made().values()) == before
    again = enrich.enrich_once(df, make, log, "id", again=True, retry_attempts=1).filter("id = 5").first()
    assert sum(made().values()) == before + 1 and (again.success, again.error) == (False, "no result")


def test_calls_side_by_side(spark):
    import threading

    def make():
        both = threading.Barrier(2, timeout=20)

        def call(text):
            both.wait()
            return 1.0

        return call

    df = spark.range(4).selectExpr("id", "'x' AS text").coalesce(1)
    assert [r.success for r in enrich.enrich_chunks(df, make, parallel=2).collect()] == [True] * 4


@pytest.mark.parametrize("batches", [1, 4])
def test_state_of_an_ended_job_is_gone(spark, tmp_path, batches):
    pytest.importorskip("google.protobuf")
    kinds = ["PIPELINE_START", "SECTION_1_START", "SECTION_1_COMPLETE", "SECTION_2_START", "SECTION_2_TTS_COMPLETE", "SECTION_2_COMPLETE", "SECTION_3_START", "PIPELINE_COMPLETE"]
    made = spark.createDataFrame([(j, o, k) for j in (1, 2) for o, k in enumerate(kinds) if not (j == 2 and o == 7)], "job_id bigint, ord bigint, type string")
    for i in range(batches):
        made.filter(f"ord * {batches} div 8 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id bigint, ord bigint, type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, progress = str(tmp_path / "out"), []
    q = live.live_sections(stream).writeStream.foreachBatch(live.batch_writer(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    rows = live.read_batches(spark, out, StructType.fromDDL("job_id bigint, current int, completed array<int>, ended boolean, batch_id bigint")).orderBy("batch_id").collect()
    last = {r.job_id: (r.current, r.completed, r.ended) for r in rows}
    assert last == {1: (3, [1, 2], True), 2: (3, [1, 2], False)}
    # of the second job its place and two sections; nothing of the first
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 3
    steps = spark.createDataFrame([(1, 0, 2.0, 1), (1, 1, 4.0, 0), (2, 0, 2.0, 1)], "job_id bigint, ord bigint, seconds double, remaining bigint")
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    eta = live.live_eta(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps")))
    q2 = eta.writeStream.format("memory").queryName(f"ended_{batches}").outputMode("update").trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert {r.job_id: r.eta_s for r in spark.table(f"ended_{batches}").collect()} == {1: 0.0, 2: 2.0}


def test_only_pairs_asked_for_are_resolved(spark):
    rows = [(j, 0, "s", k, v) for j in range(6) for k, v in (("a", "1"), ("b", str(j // 2)), ("c", None))] + [(1, 1, "s", "a", "2"), (3, 1, "s", "d", None)]
    config = spark.createDataFrame(rows, "job_id int, layer int, section string, key string, value string")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (0, 5)], "job_a int, job_b int")
    got = sorted((r.job_a, r.job_b, r.key, r.value_a, r.value_b, r.in_a, r.in_b) for r in jobs.config_diffs(config, pairs).collect())
    assert got == [(0, 1, "a", "1", "2", True, True), (0, 5, "b", "0", "2", True, True), (2, 3, "d", None, None, False, True)]
    project = spark.createDataFrame([(j, "p") for j in range(7)], "job_id int, p string")
    for long in (1_000_000, 2):
        assert sorted((r.job_a, r.job_b) for r in jobs.changed_jobs(config, project, "p", long=long).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4), (5, 6)]
    plan = jobs.config_diffs(config, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [job_id") < plan.index("LeftSemi")


@pytest.mark.parametrize("block", ["1 second", "1 minute", "1 day"])
def test_keys_of_starts_grow_with_time_and_not_with_jobs(spark, tmp_path, block):
    drawn = np.random.default_rng(7)
    at = np.sort(drawn.integers(0, 400_000_000, 3000)) + 1_700_000_000_000_000
    rows = [(int(j) if j < 900 else None, i, int(t)) for i, (j, t) in enumerate(zip(drawn.integers(0, 901, 3000) // drawn.integers(1, 90, 3000), at))]
    made = spark.createDataFrame(rows, "job_id bigint, ord bigint, at bigint").selectExpr("job_id", "ord", "timestamp_micros(at) AS ts", "'PIPELINE_START' AS type", "'m' AS message")
    for i in range(2):
        made.filter(f"ord div 1500 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    name = f"starts_by_{block.split()[1]}"
    q = live.dedup_checkpoints(stream, block=block, buckets=8).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last, want = {}, set()
    for job, order, t in rows:
        if job not in last or t - last[job] > 10_000_000:
            want.add((job, order))
        last[job] = t
    assert {(r.job_id, r.ord) for r in spark.table(name).collect()} == want and len(want) < 2900
    if block == "1 day":
        assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 18


def row_files(folder):
    return sorted((p.parent.parent.name, p.parent.name, p.read_bytes()) for p in folder.rglob("*.txt"))


def test_row_files_lie_in_few_folders_without_checksums(spark):
    from pathlib import Path

    from lectern.plans import stream_queries

    rows = [(i % 290, "né" * (i % 5) if i % 7 else None) for i in range(300)]
    folder = Path(stream_queries._files(spark.createDataFrame(rows, "dir long, text string").repartition(8), "row-files").removeprefix("file://"))
    assert Counter((d, t) for _, d, t in row_files(folder)) == Counter((f"dir={d}", f"{t or ''}\n".encode()) for d, t in rows)
    assert not list(folder.rglob("*.crc"))  # Hadoop's local writer leaves them, and starts three processes for each file
    assert len([p for p in folder.iterdir() if p.is_dir()]) <= S.LEAST_FOLDERS < 290
    found = S.scan_assets(spark, f"file://{folder}", (".txt",))
    assert sorted(r.length for r in found.collect()) == sorted(len(t) for *_, t in row_files(folder))


def test_row_files_are_the_same_by_spark_and_in_a_second_run(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (5, "b"), (-6, None), (None, "c")], "dir long, text string")
    df = df.unionAll(spark.createDataFrame([(7, bytearray(b"\xe9"))], "dir long, text binary").selectExpr("dir", "CAST(text AS STRING) AS text"))
    for _ in range(2):
        S.write_texts(df, f"file://{tmp_path}/python")
    S.write_texts(df.filter("false"), f"file://{tmp_path}/none")
    monkeypatch.setattr(S, "local_folder", lambda *_: None)
    S.write_texts(df, f"file://{tmp_path}/spark")
    assert row_files(tmp_path / "python") == row_files(tmp_path / "spark") and len(row_files(tmp_path / "python")) == 6
    assert S.scan_assets(spark, f"file://{tmp_path}/none", (".txt",)).count() == 0


def test_texts_in_folders_below(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "c.txt").write_bytes(b" x ")
    assert [r.text for r in S.read_text_corpus(spark, str(tmp_path), recursive=True).collect()] == ["x"]


def test_a_listed_file_is_no_task(spark, tmp_path, monkeypatch):
    for i in range(80):
        (tmp_path / f"{i}.wav").write_bytes(b"1" * (i + 1))
    monkeypatch.setattr(S, "LISTED_PARTS", 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a part
    try:
        found = S.scan_assets(spark, str(tmp_path))
        assert sorted(r.length for r in found.collect()) == list(range(1, 81))
        told = found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "Coalesce 40" in told


@pytest.mark.parametrize("files, shuffles", [(8, 0), (1, 1)])
def test_steps_are_not_shuffled_where_files_are_enough(spark, tmp_path, monkeypatch, files, shuffles):
    from lectern.plans import QUERIES

    monkeypatch.setattr(S, "TASK_ROWS", 10)
    spark.range(200).selectExpr("id AS doc_id", "'en' AS lang", "'web' AS source", "'Dr. A [3] of b, c' AS text").repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    steps = QUERIES["str_cleaning_steps"](spark, str(tmp_path))
    assert steps._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") == shuffles
    assert steps.select("doc_id").distinct().count() == 200
