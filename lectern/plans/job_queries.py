"""Queries on jobs: checkpoints, attempts, settings, files, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import signal as G, text as T, time as D
from ..operators import enrich, jobs, joins, names
from ..sources import files as S
from .fixtures import ATTEMPTS, CHECKPOINTS, CONFIG, ORDER_SECTIONS, PLACED_CONFIG, SIGNALS, derived
from .registry import query, table

_PARSED = r"""(SELECT *, try_cast(string_split(type, '_')[2] AS INT) AS section, CASE WHEN type LIKE 'SECTION_%' THEN regexp_replace(type, '^SECTION_[0-9]+_', '') END AS action FROM {CHECKPOINTS})"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CHECKPOINTS)


_CATEGORY = "CASE WHEN contains(type, 'PIPELINE_START') THEN 'PIPELINE' WHEN contains(type, 'PREPROCESSING') THEN 'PREPROCESS' WHEN contains(type, 'TTS') THEN 'TTS' WHEN contains(type, 'RVC') THEN 'RVC' WHEN contains(type, 'MASTER') THEN 'MASTER' WHEN contains(type, 'COMPLETE') THEN 'COMPLETE' WHEN contains(type, 'FAILED') OR contains(type, 'ERROR') THEN 'ERROR' ELSE 'OTHER' END"
_NEXT = """CASE WHEN section IS NOT NULL AND type LIKE 'SECTION_%' THEN CASE WHEN action = 'START' THEN 'TTS generation for Section ' || section WHEN action = 'TTS_COMPLETE' THEN 'RVC processing for Section ' || section
  WHEN action = 'COMPLETE' THEN 'Start processing Section ' || (section + 1) ELSE 'Continue Section ' || section || ' processing' END WHEN contains(type, 'PIPELINE_START') THEN 'Begin preprocessing phase' ELSE 'Resume pipeline processing' END"""


@query(f"SELECT job_id, ord, {_CATEGORY} AS category, CASE WHEN type LIKE 'SECTION_%' THEN section END AS section, action, {_NEXT} AS next FROM {_PARSED}")
def str_checkpoint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.parsed(_events(spark, sf_dir)).select("job_id", "ord", T.checkpoint_category(F.col("type")).alias("category"), "section", "action", T.next_action(F.col("type")).alias("next"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'Unknown' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d') END AS date, CASE WHEN event_id % 5 = 4 THEN 'Unknown' ELSE strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN event_id % 5 = 4 THEN 'Unknown' ELSE strftime(ts, '%b %d, %Y at %I:%M:%S %p') END AS readable FROM events""")  # fmt: skip
def dt_parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).when(k == 2, F.concat(iso, F.lit("+00:00"))).when(k == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("not a time")
    return table(spark, sf_dir, "events").select("event_id", D.ts_parts(D.parse_checkpoint_ts(text)).alias("p")).select("event_id", "p.*")


_H = "CASE WHEN {v} < 60 THEN {short} WHEN {v} < 3600 THEN floor({v} / 60)::BIGINT || 'm ' || floor({v} % 60)::BIGINT || 's' ELSE floor({v} / 3600)::BIGINT || 'h ' || floor(({v} % 3600) / 60)::BIGINT || 'm' END"


@query(
    f"""SELECT event_id, {_H.format(v='v', short="v::BIGINT || 's'")} AS eta, {_H.format(v='w', short="printf('%.1fs', w)")} AS took, printf('%02d:%02d:%02d.%02d', w::BIGINT // 3600, w::BIGINT % 3600 // 60, w::BIGINT % 60, 0) AS hms
    FROM (SELECT event_id, (event_id % 9000)::DOUBLE AS v, (event_id % 9000)::DOUBLE AS w FROM events)"""
)
def dt_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("event_id") % 9000).cast("double")
    return table(spark, sf_dir, "events").select("event_id", D.human_duration(v, whole=True).alias("eta"), D.human_duration(v).alias("took"), D.hms_centis(v).alias("hms"))


@query("""SELECT event_id, printf('%02d:%02d:%02d.%02d', k // 400 // 3600, k // 400 % 3600 // 60, k // 400 % 60, k % 400 // 4) AS hms FROM (SELECT event_id, event_id * 148 % 5000000 + 2 AS k FROM events)""")
def dt_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in the middle of a hundredth of a second, cut to it: 400 parts are a second."""
    return table(spark, sf_dir, "events").select("event_id", D.hms_centis((F.col("event_id") * 148 % 5000000 + 2) / F.lit(400.0)).alias("hms"))


_SECONDS = "(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ord))) / 1e6"


@query(f"""SELECT job_id, ord, seconds, CASE WHEN ord = 0 THEN 'Start' ELSE {_H.format(v='seconds', short="printf('%.1fs', seconds)")} END AS duration FROM (SELECT job_id, ord, {_SECONDS} AS seconds FROM {{CHECKPOINTS}})""")
def win_checkpoint_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.checkpoint_durations(_events(spark, sf_dir)).select("job_id", "ord", "seconds", "duration")


_RUNS = "(SELECT *, sum(CASE WHEN type = 'PIPELINE_START' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ord)::BIGINT AS run FROM (SELECT *, type = 'PIPELINE_START' AND coalesce(lag(type) OVER (PARTITION BY job_id ORDER BY ord) = 'PIPELINE_START', false) AS twice FROM {SRC}) WHERE NOT twice)"


@query("SELECT job_id, ord, type, run FROM " + _RUNS.replace("{SRC}", "{CHECKPOINTS}"))
def win_run_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_segments(_events(spark, sf_dir)).select("job_id", "ord", "type", "run")


@query(f"SELECT job_id, run, {_CATEGORY} AS category, count(*) AS steps, sum(seconds) AS total_s, avg(seconds) AS mean_s FROM {_RUNS.replace('{SRC}', f'(SELECT *, {_SECONDS} AS seconds FROM {{CHECKPOINTS}})')} WHERE seconds IS NOT NULL GROUP BY ALL")
def agg_step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.step_durations(_events(spark, sf_dir))


@query(
    f"""SELECT job_id, ord, eta_s, CASE WHEN remaining <= 0 THEN 'complete!' WHEN eta_s IS NULL THEN 'calculating...' ELSE {_H.format(v='eta_s', short="trunc(eta_s)::BIGINT || 's'")} END AS eta
    FROM (SELECT job_id, ord, remaining, avg(seconds) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * remaining AS eta_s FROM (SELECT job_id, ord, 20 - ord AS remaining, {_SECONDS} AS seconds FROM {{CHECKPOINTS}}))"""
)
def win_rolling_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = jobs.checkpoint_durations(_events(spark, sf_dir)).withColumn("remaining", 20 - F.col("ord"))
    return jobs.rolling_eta(timed, F.col("remaining")).select("job_id", "ord", "eta_s", "eta")


@query("SELECT job_id, strftime(arg_min(ts, ord), '%Y-%m-%d %H:%M:%S') AS started, strftime(arg_max(ts, ord), '%Y-%m-%d %H:%M:%S') AS latest, (epoch_us(arg_max(ts, ord)) - epoch_us(arg_min(ts, ord))) / 1e6 AS elapsed_s FROM {CHECKPOINTS} GROUP BY job_id")
def agg_job_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return jobs.job_timeline(_events(spark, sf_dir)).select("job_id", form("started"), form("latest"), "elapsed_s")


@query(
    f"""SELECT job_id, total, list_sort(list_distinct(completed)) AS completed, current, list_sort(list_distinct(list_concat(list_filter(range(1, 9), lambda s: NOT list_contains(completed, s)), CASE WHEN current IS NULL THEN [] ELSE [current] END))) AS remaining,
    list_sort(list_distinct(files)) AS files FROM (SELECT job_id, 8 AS total, coalesce(list(section) FILTER (action = 'COMPLETE'), []) AS completed,
      (max(ROW(ord, CASE WHEN action = 'COMPLETE' THEN NULL ELSE section END)) FILTER (action IN ('START', 'TTS_COMPLETE', 'COMPLETE')))[2] AS current,
      coalesce(list('section_' || section || '_tts=' || printf('sections/section_%03d_tts.wav', section)) FILTER (action = 'TTS_COMPLETE'), []) AS files FROM {_PARSED} GROUP BY job_id)"""
)
def agg_section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    state = jobs.section_state(events, events.select("job_id").distinct().withColumn("total", F.lit(8)))
    return state.select("job_id", "total", "completed", "current", "remaining", F.transform("files", lambda f: F.concat_ws("=", f["key"], f["path"])).alias("files"))


@query("SELECT o_custkey AS job_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE * 100 AS percent FROM orders GROUP BY o_custkey")
def agg_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.completion(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "job_id"), F.col("o_orderstatus") == "F", "job_id")


@query("SELECT event_type, count(*) AS chunks, count(*) FILTER (value > 50) AS generated, count(*) FILTER (value > 50) / count(*)::DOUBLE * 100 AS percent FROM events GROUP BY event_type")
def agg_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.success_rate(table(spark, sf_dir, "events"), F.col("value") > 50, "event_type")


@query("SELECT job_id, chunk_no, bool_or(ok) AS succeeded, min(attempt) FILTER (ok) AS first_ok, max(attempt) AS tried FROM {ATTEMPTS} GROUP BY job_id, chunk_no")
def agg_attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.attempt_outcome(derived(spark, sf_dir, ATTEMPTS), ["job_id", "chunk_no"])


@query(
    f"""SELECT e.job_id, e.ord, e.type, (CASE WHEN k BETWEEN 0 AND n - 2 THEN n - 1 - k ELSE 0 END)::BIGINT AS removed, l.next FROM {{CHECKPOINTS}} e
    JOIN (SELECT job_id, count(*) AS n, job_id % 40 AS k FROM {{CHECKPOINTS}} GROUP BY job_id) USING (job_id)
    JOIN (SELECT job_id, ord AS lord, {_NEXT} AS next FROM {_PARSED}) l ON l.job_id = e.job_id AND l.lord = CASE WHEN k BETWEEN 0 AND n - 2 THEN k ELSE n - 1 END
    WHERE e.ord <= CASE WHEN k BETWEEN 0 AND n - 2 THEN k ELSE n - 1 END"""
)
def win_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rewind(_events(spark, sf_dir), F.col("job_id") % 40).select("job_id", "ord", "type", "removed", "next")


@query("SELECT job_id, ord, type FROM (SELECT *, max(CASE WHEN type LIKE '%FAILED' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ord) AS bad FROM {CHECKPOINTS}) WHERE bad = 0")
def win_halt_at_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.halt_at_first_failure(_events(spark, sf_dir), "job_id", "ord", F.col("type").endswith("FAILED")).select("job_id", "ord", "type")


@query("SELECT 'skip' AS policy, job_id, count(*) AS n FROM {CHECKPOINTS} WHERE type NOT LIKE '%FAILED' GROUP BY job_id UNION ALL SELECT 'all', job_id, count(*) FROM {CHECKPOINTS} GROUP BY job_id HAVING count(*) FILTER (type LIKE '%FAILED') = 0")
def win_failure_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, failed = _events(spark, sf_dir), F.col("type").endswith("FAILED")
    count = lambda name, policy: jobs.halt_at_first_failure(events, "job_id", "ord", failed, policy).groupBy(F.lit(name).alias("policy"), "job_id").agg(F.count("*").alias("n"))
    return count("skip", "skip_failed").unionByName(count("all", "all_or_nothing"))


_TOC = "(SELECT p_partkey // 10 AS book, p_partkey % 10 + 1 AS number, p_partkey % 10 * 25 + 1 AS start_page FROM part)"
_TOC_ENDS = f"(SELECT book, number, start_page, coalesce(lead(start_page) OVER (PARTITION BY book ORDER BY number) - 1, 250) AS end_page FROM {_TOC})"
_LINE_PAGES = "(SELECT DISTINCT l_partkey // 10 AS book, (1 + l_orderkey % 250)::INT AS page_no FROM lineitem)"


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and chapters: ten parts a book, each a chapter of 25 pages, so that both grow with the tables."""
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    book = lambda key: F.floor(F.col(key) / 10).alias("book")
    at = F.col("p_partkey") % 10
    toc = part.select(book("p_partkey"), (at + 1).cast("int").alias("number"), (at * 25 + 1).cast("int").alias("start_page"), F.lit(250).alias("n_pages"))
    pages = lineitem.select(book("l_partkey"), (1 + F.col("l_orderkey") % 250).cast("int").alias("page_no")).distinct()
    return pages, toc


@query(f"SELECT book, number, start_page, end_page::INT AS end_page FROM {_TOC_ENDS}")
def win_chapter_end_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.chapter_end_pages(_books(spark, sf_dir)[1]).select("book", "number", "start_page", "end_page")


@query(f"SELECT DISTINCT p.book, p.page_no FROM {_LINE_PAGES} p JOIN {_TOC_ENDS} c ON p.book = c.book AND p.page_no BETWEEN c.start_page AND c.end_page WHERE c.number % 3 = 0")
def join_pages_of_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, toc = _books(spark, sf_dir)
    chapters = jobs.chapter_end_pages(toc)
    return joins.pages_of_chapters(pages, chapters, chapters.filter("number % 3 = 0").select("book", "number"))


@query(f"""SELECT DISTINCT p.book, p.page_no FROM {_LINE_PAGES} p JOIN (SELECT c.book, CASE WHEN c.book % 2 = 0 THEN c.start_page ELSE c.number END AS a, CASE WHEN c.book % 2 = 0 THEN c.end_page ELSE c.number END AS b FROM {_TOC_ENDS} c WHERE c.number % 3 = 0) r
    ON p.book = r.book AND p.page_no BETWEEN r.a AND r.b""")
def join_pages_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other book has a single chapter, so its numbers are those of pages."""
    pages, toc = _books(spark, sf_dir)
    chapters = jobs.chapter_end_pages(toc)
    wanted = chapters.filter("number % 3 = 0").select("book", "number")
    return joins.pages_wanted(pages, chapters.filter("book % 2 = 0 OR number = 1"), wanted)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS part_no, coalesce(sum(length(text) * 0.06 + CASE WHEN role = 'user' THEN 0.4 ELSE 0.3 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start_s FROM conversations")
def win_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("part_no", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    return jobs.timeline(turns, "conv_id", "turn", F.length("text") * F.lit(0.06), F.when(F.col("role") == "user", 0.4).otherwise(0.3)).select("conv_id", "turn", "part_no", "start_s")


_BATCHES = """(SELECT c_custkey AS job_id, c_nationkey AS project, coalesce(batch, 'complete') AS batch FROM customer LEFT JOIN (SELECT job_id, 'batch' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, '_' ORDER BY a) AS batch FROM
  (SELECT job_id, min(section) AS a, max(section) AS b FROM (SELECT job_id, section, section - row_number() OVER (PARTITION BY job_id ORDER BY section) AS island FROM (SELECT DISTINCT job_id, section FROM {ORDER_SECTIONS})) GROUP BY job_id, island) GROUP BY job_id) ON job_id = c_custkey)"""  # fmt: skip


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as jobs, of which a third has no sections, in projects by nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("project"))


@query(f"SELECT job_id, batch FROM {_BATCHES}")
def win_compact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.compact_ranges(derived(spark, sf_dir, ORDER_SECTIONS), "job_id", "section", _jobs(spark, sf_dir))


def _free_names(names: str, unit: str, key: str = "p_partkey") -> str:
    """Names asked for one after another by key, each given as the first that no name before has: the
    number is counted up from 2 until the name is new. Only names of one beginning can meet."""
    tried = unit.replace("{x}", "j")
    return f"""WITH RECURSIVE asked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY {key}) AS n FROM ({names})),
      given AS (SELECT root, 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::BIGINT AS {key}, NULL::VARCHAR AS unique_name FROM (SELECT DISTINCT root FROM asked)
        UNION ALL SELECT root, n, list_append(taken, got), {key}, got FROM (SELECT g.root, a.n, g.taken, a.{key},
          CASE WHEN list_contains(g.taken, name) THEN list_filter(list_transform(range(2, len(g.taken) + 3), lambda j: {tried}), lambda x: NOT list_contains(g.taken, x))[1] ELSE name END AS got
          FROM given g JOIN asked a ON a.root = g.root AND a.n = g.n + 1))
      SELECT {key}, unique_name FROM given WHERE n > 0"""


#: Some names end in a number that others are given.
_NAMED = "p_name || CASE CAST(p_partkey % 7 AS INT) WHEN 2 THEN '_2' WHEN 4 THEN '_3' WHEN 5 THEN CASE WHEN p_partkey % 3 = 0 THEN '_2_2' ELSE '' END ELSE '' END"
_FILED = "p_brand || CASE CAST(p_partkey % 5 AS INT) WHEN 1 THEN '_2' WHEN 3 THEN '_12' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '.tar.wav' ELSE '' END"


@query(_free_names(f"SELECT p_partkey, {_NAMED} AS name, regexp_replace({_NAMED}, '(_[0-9]+)+$', '') AS root FROM part", "name || '_' || {x}"))
def win_suffix_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMED).alias("name"))
    return names.suffix_collisions(named, "name", "p_partkey").select("p_partkey", "unique_name")


@query(_free_names(rf"SELECT p_partkey, {_FILED} AS name, regexp_replace(regexp_replace({_FILED}, '\.[^.]+$', ''), '(_[0-9]+)+$', '') || CASE WHEN p_partkey % 3 = 0 THEN '/wav' ELSE '' END AS root FROM part", r"regexp_replace(name, '\.[^.]+$', '') || '_' || {x} || regexp_extract(name, '(\.[^.]+)?$', 1)"))
def win_file_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number goes before the suffix of a file name."""
    files = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILED).alias("name"))
    return names.suffix_collisions(files, "name", "p_partkey", stem_aware=True).select("p_partkey", "unique_name")


@query(
    f"""WITH few AS (SELECT c_custkey AS job_id, c_nationkey AS project, CASE WHEN c_custkey % 3 = 0 THEN 'complete' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 7 = 0 THEN 'batch3_5' ELSE 'batch3' END ELSE 'batch1-2' END AS batch FROM customer)
    SELECT job_id, project, batch, unique_name AS batch_name FROM few JOIN ({_free_names("SELECT job_id, batch AS name, project || '/' || regexp_replace(batch, '(_[0-9]+)+$', '') AS root FROM few", "name || '_' || {x}", "job_id")}) USING (job_id)"""
)
def win_batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a few sections, or none, so that most names of a project are asked for again; ``batch3_5`` is
    also what the fifth ``batch3`` would get."""
    made = _jobs(spark, sf_dir)
    k = F.col("job_id")
    asked = F.when(k % 3 == 0, F.array(F.lit(None).cast("int"))).when(k % 3 == 1, F.when(k % 7 == 0, F.array(F.lit(5), F.lit(3), F.lit(3))).otherwise(F.array(F.lit(3)))).otherwise(F.array(F.lit(2), F.lit(1)))
    sections = made.filter(k % 6 != 0).select("job_id", F.explode(asked).alias("section"))
    return jobs.batch_names(sections, made, "job_id", "section", "project")


_ROLLED = "SELECT DISTINCT job_id, section FROM {ORDER_SECTIONS}"


@query("""SELECT DISTINCT job_id, section FROM (SELECT j.job_id, s.section::INT AS section FROM (SELECT job_id, max(section) AS total FROM {ORDER_SECTIONS} GROUP BY job_id) j JOIN (SELECT unnest(range(1, 100)) AS section) s ON s.section <= j.total
    WHERE NOT EXISTS (SELECT 1 FROM {ORDER_SECTIONS} o WHERE o.job_id = j.job_id AND o.section = s.section AND o.status = 'F') UNION ALL SELECT job_id, max(section) FROM {ORDER_SECTIONS} GROUP BY job_id)""")  # fmt: skip
def join_pending_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job has as many sections as its largest number says."""
    made = derived(spark, sf_dir, ORDER_SECTIONS)
    current = made.groupBy("job_id").agg(F.max("section").alias("section"))
    return joins.pending_sections(current.withColumnRenamed("section", "total"), made.filter("status = 'F'").select("job_id", "section"), current)


@query(f"SELECT DISTINCT job_id, section FROM {_PARSED} p WHERE action = 'COMPLETE' AND NOT EXISTS (SELECT 1 FROM {_PARSED} q WHERE q.job_id = p.job_id AND q.section = p.section AND q.action = 'START' AND q.ord % 2 = 0)")
def join_unmastered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = jobs.parsed(_events(spark, sf_dir))
    even_start = (F.col("action") == "START") & (F.col("ord") % 2 == 0)
    return joins.unmastered_sections(p.withColumn("action", F.when(even_start, "MASTER_COMPLETE").otherwise(F.col("action"))))


@query("""SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.section, b.section) AS section, a.section IS NOT NULL AS in_state, b.section IS NOT NULL AS on_disk, a.section IS NOT NULL AND b.section IS NULL AS missing
  FROM (SELECT DISTINCT job_id, section FROM {ORDER_SECTIONS} WHERE status <> 'P') a FULL JOIN (SELECT DISTINCT job_id, section FROM {ORDER_SECTIONS} WHERE o_orderkey % 4 <> 0) b ON a.job_id = b.job_id AND a.section = b.section""")  # fmt: skip
def join_reconcile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived(spark, sf_dir, ORDER_SECTIONS)
    pick = lambda test: made.filter(test).select("job_id", "section").distinct()
    return joins.reconcile_files(pick("status <> 'P'"), pick("o_orderkey % 4 <> 0"))


@query("""SELECT a.job_id, a.section, a.step, coalesce(b.path, printf('sections/section_%03d_%s.wav', a.section, a.step)) AS path FROM (SELECT DISTINCT job_id, section, CASE WHEN status = 'F' THEN 'rvc' ELSE 'tts' END AS step FROM {ORDER_SECTIONS}) a
  LEFT JOIN (SELECT DISTINCT job_id, section, 'tts' AS step, 'kept/' || section || '.wav' AS path FROM {ORDER_SECTIONS} WHERE o_orderkey % 5 = 0) b ON a.job_id = b.job_id AND a.section = b.section AND a.step = b.step""")  # fmt: skip
def join_section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived(spark, sf_dir, ORDER_SECTIONS)
    done = made.select("job_id", "section", F.when(F.col("status") == "F", "rvc").otherwise("tts").alias("step")).distinct()
    kept = made.filter("o_orderkey % 5 = 0").select("job_id", "section", F.lit("tts").alias("step"), F.concat(F.lit("kept/"), F.col("section").cast("string"), F.lit(".wav")).alias("path")).distinct()
    return joins.section_files(done, kept)


@query("SELECT c_custkey AS job_id, k AS key FROM customer, (VALUES ('balance'), ('priority'), ('nation')) v(k) WHERE NOT EXISTS (SELECT 1 FROM {CONFIG} c WHERE c.job_id = c_custkey AND c.key = k AND c.layer >= 1 AND c.value IS NOT NULL)")
def join_missing_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.explode(F.array(F.lit("balance"), F.lit("priority"), F.lit("nation"))).alias("key"))
    return joins.missing_required_keys(derived(spark, sf_dir, CONFIG).filter("layer >= 1"), required, ["job_id", "key"])


@query("SELECT job_id, section, key, arg_max_null(value, layer) AS value FROM {CONFIG} GROUP BY job_id, section, key")
def cfg_resolve_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.resolve_layers(derived(spark, sf_dir, PLACED_CONFIG))


_LAYERS = "(SELECT job_id, section, key, arg_max_null(value, layer) AS value FROM {CONFIG} GROUP BY job_id, section, key)"


@query(f"""SELECT coalesce(a.section, b.section) AS section, coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b, a.key IS NOT NULL AS in_a, b.key IS NOT NULL AS in_b
    FROM (SELECT * FROM {_LAYERS} WHERE job_id = (SELECT min(c_custkey) FROM customer)) a FULL JOIN (SELECT * FROM {_LAYERS} WHERE job_id = (SELECT max(c_custkey) FROM customer)) b ON a.section = b.section AND a.key = b.key
    WHERE a.value IS DISTINCT FROM b.value OR a.key IS NULL OR b.key IS NULL""")  # fmt: skip
def cfg_config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "customer").agg(F.min("c_custkey").alias("job_a"), F.max("c_custkey").alias("job_b"))
    return jobs.config_diffs(derived(spark, sf_dir, PLACED_CONFIG), ends).drop("job_a", "job_b")


@query(f"""WITH l AS {_LAYERS}, d AS (SELECT c_nationkey AS project, c_custkey AS job_id, string_agg(section || chr(31) || key || chr(31) || coalesce('1' || value, '0'), chr(30) ORDER BY section, key) AS settings FROM customer JOIN l ON job_id = c_custkey GROUP BY ALL),
    p AS (SELECT project, lag(job_id) OVER w AS job_a, job_id AS job_b, settings <> lag(settings) OVER w AS differ FROM d WINDOW w AS (PARTITION BY project ORDER BY job_id)), c AS (SELECT * FROM p WHERE differ),
    a AS (SELECT job_a, job_b, section, key, value FROM c JOIN l ON l.job_id = job_a), b AS (SELECT job_a, job_b, section, key, value FROM c JOIN l ON l.job_id = job_b)
    SELECT coalesce(a.job_a, b.job_a) AS job_a, coalesce(a.job_b, b.job_b) AS job_b, coalesce(a.section, b.section) AS section, coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b, a.key IS NOT NULL AS in_a, b.key IS NOT NULL AS in_b
    FROM a FULL JOIN b ON a.job_a = b.job_a AND a.job_b = b.job_b AND a.section = b.section AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value OR a.key IS NULL OR b.key IS NULL""")  # fmt: skip
def cfg_changed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has changed in the settings from each job of a nation to the next."""
    config = derived(spark, sf_dir, PLACED_CONFIG)
    return jobs.config_diffs(config, jobs.changed_jobs(config, _jobs(spark, sf_dir), "project"))


@query("SELECT coalesce(a.profile, b.profile) AS profile, coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN b.value ELSE a.value END AS value FROM (SELECT job_id AS profile, key, max(value) AS value FROM {CONFIG} WHERE layer = 0 GROUP BY ALL) a FULL JOIN (SELECT job_id AS profile, key, max(value) AS value FROM {CONFIG} WHERE layer > 0 GROUP BY ALL) b ON a.profile = b.profile AND a.key = b.key")
def join_merge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived(spark, sf_dir, CONFIG)
    side = lambda test: made.filter(test).groupBy(F.col("job_id").alias("profile"), "key").agg(F.max("value").alias("value"))
    return joins.merge_profiles(side("layer = 0"), side("layer > 0"))


@query("SELECT DISTINCT job_id, section, key FROM {CONFIG} WHERE key IN (SELECT CASE WHEN r_regionkey = 0 THEN 'balance' ELSE 'priority' END FROM region)")
def set_accepted_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "balance").otherwise("priority").alias("key"))
    return joins.accepted_params(derived(spark, sf_dir, CONFIG), allowed).select("job_id", "section", "key").distinct()


@query("SELECT job_id, replace(section, 'rvc_', '') AS profile, coalesce(max(value) FILTER (key = 'model'), 'Unknown') AS model FROM (SELECT job_id, 'rvc_' || CASE WHEN section = 'BUILDING' THEN 'global' ELSE section END AS section, CASE WHEN key = 'priority' THEN 'model' ELSE key END AS key, value FROM {CONFIG}) WHERE section <> 'rvc_global' GROUP BY job_id, section")
def map_list_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived(spark, sf_dir, CONFIG).select("job_id", F.concat(F.lit("rvc_"), F.when(F.col("section") == "BUILDING", "global").otherwise(F.col("section"))).alias("section"), F.when(F.col("key") == "priority", "model").otherwise(F.col("key")).alias("key"), "value")
    return jobs.list_profiles(made)


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def map_config_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jobs.config_value(F.col("props"), "k").alias("value"))


@query("SELECT c_custkey AS job_id, 'kept' AS speed, CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer")
def map_generation_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("speed"), F.lit("kept"))
    config = F.create_map(F.lit("speed"), F.lit("lost"), F.lit("segment"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")), F.lit("secret"), F.lit("x"))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), jobs.generation_params(base, config, ["speed", "segment"]).alias("m"))
    return made.select("job_id", F.try_element_at("m", F.lit("speed")).alias("speed"), F.try_element_at("m", F.lit("segment")).alias("segment"))


_VOICES = "SELECT n_nationkey AS catalog_pos, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'de' END || '-' || CASE WHEN n_nationkey % 4 < 2 THEN 'US' ELSE 'DE' END || '-' || n_name AS voice FROM nation"
_REQUESTS = "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 'en' WHEN c_custkey % 7 = 1 THEN 'en-U' WHEN c_custkey % 7 = 2 THEN 'de-D-x' WHEN c_custkey % 7 = 3 THEN 'de-' WHEN c_custkey % 7 = 4 THEN 'xx-YY-z' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'de' END || '-' || CASE WHEN c_nationkey % 4 < 2 THEN 'US' ELSE 'DE' END || '-' || n_name END AS voice, CASE WHEN c_custkey % 5 = 0 THEN 'en-US-' || n_name END AS fallback FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(
    f"""WITH v AS ({_VOICES}), r AS ({_REQUESTS}) SELECT request_id, CASE WHEN e.voice IS NULL AND f.voice IS NOT NULL THEN fallback ELSE r.voice END AS voice, CASE WHEN e.voice IS NOT NULL THEN 'exact' WHEN f.voice IS NOT NULL THEN 'fallback' ELSE 'unverified' END AS how,
    CASE WHEN e.voice IS NULL AND f.voice IS NULL THEN (SELECT string_agg(voice, ',' ORDER BY catalog_pos) FROM (SELECT * FROM v x WHERE starts_with(x.voice, CASE WHEN contains(r.voice, '-') THEN split_part(r.voice, '-', 1) || '-' || split_part(r.voice, '-', 2) ELSE 'en-' END) ORDER BY catalog_pos LIMIT 3)) END AS suggestions
    FROM r LEFT JOIN v e ON e.voice = r.voice LEFT JOIN v f ON f.voice = r.fallback"""
)
def join_resolve_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.resolve_voice(derived(spark, sf_dir, _REQUESTS), derived(spark, sf_dir, _VOICES))


@query("SELECT o_custkey AS key, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def set_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.dedupe_keep_first(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderpriority"), "key", "o_orderkey")


@query("SELECT dir, path, priority FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY priority, mtime DESC, path) AS n FROM (SELECT o_custkey AS dir, o_orderkey::VARCHAR AS path, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS priority, o_orderdate AS mtime FROM orders) WHERE priority IS NOT NULL) WHERE n = 1")
def top_latest_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dir"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"), "o_orderstatus")
    return jobs.latest_output(files, F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)).select("dir", "path", "priority")


@query("SELECT p_brand AS dir, arg_min(p_partkey::VARCHAR, lower(p_name) || chr(1) || p_partkey) AS path FROM part GROUP BY p_brand")
def top_primary_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.primary_sample(table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("name")))


@query("SELECT s_nationkey, s_suppkey, rank FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank FROM supplier) WHERE rank <= 3")
def top_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.top_by_group(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 3).select("s_nationkey", "s_suppkey", "rank")


@query("SELECT conv_id, turn, ordinal_pos AS request_pos FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations) JOIN (SELECT doc_id AS conv_id, (n_chars % 9)::INT AS ordinal, (doc_id % 3)::INT AS ordinal_pos FROM documents) USING (conv_id) WHERE ordinal >= 1 AND part = ordinal")
def flt_select_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").withColumn("part", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), (F.col("n_chars") % 9).cast("int").alias("ordinal"), (F.col("doc_id") % 3).cast("int").alias("request_pos"))
    return S.select_ordinals(parts, asked, "conv_id", "part").select("conv_id", "turn", "request_pos")


@query("""SELECT doc AS conv_id, total, NOT bool_or(bad) AS valid, arg_min(ordinal, pos) FILTER (bad) AS first_bad FROM (SELECT doc, ordinal, pos, coalesce(total, 0)::INT AS total, ordinal < 1 OR ordinal > coalesce(total, 0) AS bad FROM
  (SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations) AS doc, (n_chars % 9)::INT AS ordinal, doc_id AS pos FROM documents) LEFT JOIN (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id) ON conv_id = doc) GROUP BY doc, total""")  # fmt: skip
def flt_validate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt over all conversations."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.agg((F.max("conv_id") + 1).alias("ids"))
    asked = table(spark, sf_dir, "documents").crossJoin(F.broadcast(ids)).select((F.col("doc_id") % F.col("ids")).alias("conv_id"), (F.col("n_chars") % 9).cast("int").alias("ordinal"), F.col("doc_id").alias("request_pos"))
    return S.validate_ordinals(turns, asked, "conv_id").select("conv_id", "total", "valid", "first_bad")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 3 THEN list_sort(list_distinct([p_size, 3]))::INT[] ELSE list_sort(list_distinct(list_concat(range(p_size, p_size + (p_partkey % 5)::INT + 1), [7])))::INT[] END AS numbers FROM part""")
def flt_expand_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("int"), F.col("p_partkey") % 5
    text = lambda c: c.cast("string")
    run = F.concat(text(size), F.lit("-"), text(size + k.cast("int")), F.lit(" 7"))
    spec = F.when(k == 4, "3-x 5").when(k == 3, F.concat(text(size), F.lit(" 9-7 3"))).otherwise(run)
    return table(spark, sf_dir, "part").select("p_partkey", S.expand_ranges(spec).alias("numbers"))


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars % 7 = 0 THEN 'empty' END AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_chars FROM documents)")
def flt_usable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    files = docs.filter("doc_id % 5 <> 0").select("path", F.when(F.col("n_chars") % 7 == 0, 0).otherwise(F.col("n_chars")).alias("length"))
    return S.usable_files(docs.select("doc_id", "path"), files).select("doc_id", "reason")


@query("SELECT c_custkey AS job_id FROM customer WHERE NOT (c_nationkey % 2 = 0) OR c_nationkey % 3 = 0 OR c_nationkey % 5 = 0")
def flt_jobs_needing_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    phases = F.when(n % 3 != 0, F.create_map(F.lit("preprocessing"), F.struct((n % 2 == 0).alias("complete")))).otherwise(F.create_map(F.lit("other"), F.struct(F.lit(True).alias("complete"))))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), phases.alias("phases"), F.struct(F.when(n % 5 != 0, 4).otherwise(0).alias("total")).alias("sections"))
    return S.jobs_needing_preprocessing(made).select("job_id")


# ---- signals ------------------------------------------------------------------------------------

_ROUND = "list_transform({}, lambda x: round(x, 5) + 0)"


def _rounded(c, places: int = 5):
    """Rounded as the SQL does it: scaled, rounded to an integer, scaled back. Spark's own ``round`` looks at
    the decimal digits, so it parts from that next to halves."""
    return F.transform(c, lambda x: F.round(x * 10.0**places) / 10.0**places + 0)


@query("SELECT vec_id, max(abs(x)) AS peak, avg(abs(x)) AS energy, len(any_value(samples)) / 10.0::DOUBLE AS seconds FROM (SELECT vec_id, samples, unnest(samples)::DOUBLE AS x FROM {SIGNALS}) GROUP BY vec_id")
def agg_signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("samples")
    return derived(spark, sf_dir, SIGNALS).select("vec_id", G.peak(s).cast("double").alias("peak"), G.mean_abs(s).alias("energy"), G.duration_s(s, F.col("rate")).alias("seconds"))


@query(f"""SELECT vec_id, {_ROUND.format("list_transform(samples, lambda v: v::DOUBLE / list_max(list_transform(samples, lambda q: abs(q::DOUBLE))) * 0.95)")} AS normal,
  list_transform(samples, lambda v: trunc(v::DOUBLE * 32767)::INT) AS pcm FROM {{SIGNALS}}""")  # fmt: skip
def aud_normalize_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("samples")
    return derived(spark, sf_dir, SIGNALS).select("vec_id", _rounded(G.peak_normalize(s)).alias("normal"), F.transform(G.quantize_int16(s), lambda x: x.cast("int")).alias("pcm"))


@query(f"""SELECT vec_id, {_ROUND.format("list_transform(samples, lambda v, i: CASE WHEN i > len(samples) - 10 THEN v::DOUBLE * (1 - (i - 1 - (len(samples) - 10)) / 9.0) ELSE v::DOUBLE END)")} AS faded FROM {{SIGNALS}}""")
def aud_fade_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SIGNALS).select("vec_id", _rounded(G.fade_out(F.col("samples"), F.col("rate"), 1.0)).alias("faded"))


@query("SELECT vec_id, len(samples) / 10.0 > (1 + vec_id % 60) * 0.2 OR list_max(list_transform(samples, lambda q: abs(q))) < 0.3 AS suspect FROM {SIGNALS}")
def aud_artifact_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.repeat(F.lit("x"), (1 + F.col("vec_id") % 60).cast("int"))
    return derived(spark, sf_dir, SIGNALS).select("vec_id", G.artifact_flag(F.col("samples"), F.col("rate"), text, quiet=0.3).alias("suspect"))


_TAIL = "(CASE WHEN vec_id % 2 = 0 THEN list_transform(samples, lambda v, i: CASE WHEN i > 57 THEN v / 100 ELSE v END) ELSE samples END)"


@query(f"""SELECT vec_id, len(CASE WHEN list_avg(list_transform(s[58:64], lambda q: abs(q))) < 0.1 * list_avg(list_transform(s[48:57], lambda q: abs(q))) THEN s[1:57] ELSE s END)::INT AS kept FROM (SELECT vec_id, {_TAIL} AS s FROM {{SIGNALS}})""")
def aud_trim_quiet_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("vec_id") % 2 == 0, F.transform("samples", lambda v, i: F.when(i > 56, v / 100).otherwise(v))).otherwise(F.col("samples"))
    return derived(spark, sf_dir, SIGNALS).withColumn("s", s).select("vec_id", F.size(G.trim_quiet_tail(F.col("s"), F.col("rate"))).alias("kept"))


@query("SELECT vec_id, coalesce(max(i) - min(i) + 1, 64)::INT AS kept, coalesce(min(i), 1)::INT AS start FROM (SELECT vec_id FROM {SIGNALS}) LEFT JOIN (SELECT vec_id, i FROM (SELECT vec_id, unnest(samples) AS x, generate_subscripts(samples, 1) AS i FROM {SIGNALS}) WHERE abs(x) > 0.12) USING (vec_id) GROUP BY vec_id")
def aud_trim_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.trim_silence(F.col("samples"), 0.12)
    first = F.array_position(F.transform("samples", lambda x: F.abs(x) > 0.12), True)
    return derived(spark, sf_dir, SIGNALS).select("vec_id", F.size(s).alias("kept"), F.greatest(first, F.lit(1)).cast("int").alias("start"))


@query("""SELECT vec_id, list(round(v, 4) + 0 ORDER BY i) AS slow FROM (SELECT vec_id, i, samples[lo + 1]::DOUBLE * (1 - (place - lo)) + samples[least(lo + 1, 63) + 1]::DOUBLE * (place - lo) AS v FROM
  (SELECT *, floor(place)::INT AS lo FROM (SELECT vec_id, samples, i, greatest((i + 0.5) * 64 / 80.0 - 0.5, 0) AS place FROM {SIGNALS}, (SELECT unnest(range(0, 80)) AS i)))) GROUP BY vec_id""")  # fmt: skip
def aud_resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SIGNALS).select("vec_id", _rounded(G.resample_linear(F.col("samples"), 0.8), 4).alias("slow"))


@query("""SELECT label, vec_id, (sum(len(samples) + 3) OVER w - (len(samples) + 3))::BIGINT AS "offset", list_concat(list_transform(samples, lambda q: q::DOUBLE), CASE WHEN lead(vec_id) OVER w IS NULL THEN [] ELSE [0.0, 0.0, 0.0]::DOUBLE[] END) AS samples
  FROM {SIGNALS} WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")  # fmt: skip
def aud_concat_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label end to end, with gaps of 0.3 s."""
    return G.concat_with_gaps(derived(spark, sf_dir, SIGNALS), "label", "vec_id").select("label", "vec_id", "offset", "samples")


@query("SELECT doc_id, lang, length(text)::DOUBLE AS payload, true AS success, 1 AS attempts FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, lang, NULL, false, 3 FROM documents WHERE doc_id % 10 = 0")
def udf_enrich_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        return lambda text: None if text.startswith("!") else float(len(text) - 1)

    marked = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.when(F.col("doc_id") % 10 == 0, "!").otherwise("."), F.col("text")).alias("text"))
    return enrich.enrich_chunks(marked, make).select("doc_id", "lang", "payload", "success", "attempts")


@query("SELECT doc_id, 2.0::DOUBLE AS payload, true AS success, CASE WHEN length(text) % 2 = 0 THEN 2 ELSE 3 END AS attempts FROM documents".replace("2.0::DOUBLE AS payload", "(CASE WHEN length(text) % 2 = 0 THEN 2 ELSE 3 END)::DOUBLE AS payload"))
def udf_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload is the number of the try; texts of even length are content with the second, the others
    with none, so that the last is taken."""

    def make():
        return lambda text, attempt: float(attempt)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gated = enrich.enrich_chunks(docs, make, accept=lambda text, payload: len(text) % 2 == 0 and payload >= 2, numbered=True)
    return gated.select("doc_id", "payload", "success", "attempts")


@query("SELECT conv_id, turn, (conv_id % 7)::INT AS request_pos FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS part, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE part = 1 + conv_id % n")
def flt_select_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of each conversation, where a request past the last part would be an error."""
    parts = table(spark, sf_dir, "conversations").withColumn("part", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    asked = parts.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", (1 + F.col("conv_id") % F.col("n")).cast("int").alias("ordinal"), (F.col("conv_id") % 7).cast("int").alias("request_pos"))
    return S.select_ordinals(parts, asked, "conv_id", "part", strict=True).select("conv_id", "turn", "request_pos")


@query("SELECT l_orderkey, l_linenumber, l_quantity / 10 < 0.25 OR l_quantity / 10 > 4 AS bad_speed, l_returnflag NOT IN ('A', 'N') AS bad_model, l_linestatus <> 'O' AS bad_voice, l_extendedprice / 1e6 * 15 AS usd FROM lineitem")
def mth_flags_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = enrich.in_range_flags(F.col("l_quantity") / 10, F.col("l_returnflag"), F.col("l_linestatus"), ["A", "N"], ["O"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flags.alias("f"), enrich.est_cost(F.col("l_extendedprice"), F.lit(15)).alias("usd")).select("l_orderkey", "l_linenumber", "f.*", "usd")
