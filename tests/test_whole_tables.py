"""Queries that must read all of their tables, and hold no group of them whole."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from lectern.plans import QUERIES, stream_queries
from lectern.sources import files as S
from lectern.streaming import live
from tests.conftest import SF


def test_all_documents_are_paired(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["join_pair_samples"](spark, SF)
    assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_derived_inputs_grow_with_the_tables(spark):
    larger = SF.replace("sf0.001", "sf0.1")
    talks = spark.read.parquet(f"{larger}/conversations.parquet").groupBy("conv_id").count()
    checked = QUERIES["flt_validate_ordinals"](spark, larger)
    assert talks.join(checked, "conv_id", "left_anti").count() == 0
    assert checked.join(talks, "conv_id").filter("total <> count").count() == 0

    orders = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_custkey", "CAST(o_orderkey % 100 AS INT) AS section", "o_orderstatus").collect()
    done, last = set(), {}
    for r in orders:
        done |= {(r.o_custkey, r.section)} if r.o_orderstatus == "F" else set()
        last[r.o_custkey] = max(r.section, last.get(r.o_custkey, 0))
    pending = {(j, n) for j, m in last.items() for n in range(1, m + 1) if (j, n) not in done} | set(last.items())
    assert {tuple(r) for r in QUERIES["join_pending_sections"](spark, SF).select("job_id", "section").collect()} == pending

    lines = spark.read.parquet(f"{larger}/lineitem.parquet").select("l_partkey", "l_orderkey").distinct().collect()
    parts = {r.p_partkey for r in spark.read.parquet(f"{larger}/part.parquet").select("p_partkey").collect()}

    def chapter(book, page):
        return max((k % 10 + 1 for k in range(book * 10, book * 10 + 10) if k in parts and k % 10 * 25 < page), default=0)

    want = {p for p in {(r.l_partkey // 10, 1 + r.l_orderkey % 250) for r in lines} if (c := chapter(*p)) and c % 3 == 0}
    assert {tuple(r) for r in QUERIES["join_pages_of_chapters"](spark, larger).select("book", "page_no").collect()} == want


def test_last_steps_are_trimmed_at_each_batch():
    made = live._LastSteps()
    made.steps = SimpleNamespace(exists=lambda: False, get=list, put=lambda steps: None)
    batches = (pd.DataFrame({"ord": np.arange(i * 5000, i * 5000 + 5000), "seconds": 2.0, "remaining": 4}) for i in range(40))
    tracemalloc.start()
    out = next(made.handleInputRows((1,), batches, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.values.tolist() == [[1, 199_999, 8]] and peak < 6_000_000


def test_a_long_log_is_written_in_parts(spark, tmp_path):
    events = spark.range(50).selectExpr("id % 2 AS user_id", "id AS event_id", "struct('t' AS timestamp, 'error' AS type, CAST(id % 2 AS STRING) AS message) AS c")
    stream_queries._write_progress(events, str(tmp_path / "log"), ids=10)
    read = S.read_progress_logs(spark, str(tmp_path / "log"))
    assert read.count() == 50 and sorted(r["count"] for r in read.groupBy("path").count().collect()) == [5] * 10


def test_equal_texts_in_a_row_are_tried_each_for_itself(spark, tmp_path):
    texts = ["odd", "odd", "odd", "even", "even", "even", "even", None, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["udf_quality_gate"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.payload, r.success, r.attempts) for r in got] == [(n, True, n) for n in (3, 3, 3, 2, 2, 2, 2, 3, 3)]


@pytest.mark.parametrize("name", ["src_config_snapshots", "src_progress_logs"])
def test_records_of_many_jobs_share_a_file(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(stream_queries, "scratch_folder", lambda spark, label: str(tmp_path / label))
    jobs = QUERIES[name](spark, SF).select("job_id").distinct().count()
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    assert jobs >= 15 and 1 <= len(files) <= 4


def test_lines_are_records(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"project": "a", "checkpoints": [{"type": "x"}, {"type": "y"}]}\nnot json\n{"project": "b", "checkpoints": [{"type": "z"}]}\n')
    rows = S.read_progress_logs(spark, str(tmp_path / "p.json"), lines=True).collect()
    assert sorted((r.project, r.ord, r.type) for r in rows) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    (tmp_path / "c.txt").write_text('{"s": {"k": "v", "n": null}}\n{"t": {"k": "w"}}\n')
    rows = S.read_config_snapshots(spark, str(tmp_path / "c.txt"), lines=True).collect()
    assert {(r.section, r.key, r.value) for r in rows} == {("s", "k", "v"), ("s", "n", None), ("t", "k", "w")}


def test_tasks_on_texts_are_bounded_in_rows(spark, tmp_path, monkeypatch):
    """a table of few large files is dealt in tasks of so many rows, not in one for each core."""
    spark.range(1000).selectExpr("id", "cast(id AS STRING) AS text").repartition(6).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert S.spread(table).rdd.getNumPartitions() == table.rdd.getNumPartitions()
    monkeypatch.setattr(S, "TASK_ROWS", 50)
    dealt = S.spread(table)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 1000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_cleaned_once(spark):
    """the filter on the cleaned text is no second copy of the work."""
    assert plan_of(QUERIES["flt_page_artifact_lines"](spark, SF)).count("\nPage 3 of 9\n") == 1


def test_digits_are_found_by_one_pattern(spark):
    """not by ten, of which each reads the whole text and looks for a word's edge at each sign."""
    plan = plan_of(QUERIES["str_normalize_for_speech"](spark, SF))
    assert not any(rf"\b{i}\b" in plan for i in range(10))
