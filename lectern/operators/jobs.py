"""What checkpoints, attempts and chunks tell of jobs: aggregates and windows by job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..functions import text as T, time as D
from .names import suffix_collisions
from .ordered import LONG, running

CURRENT_ACTIONS = ("START", "TTS_COMPLETE", "RVC_COMPLETE", "MASTER_COMPLETE", "MASTER_FAILED")


def by_job(order: str = "ord"):
    return W.partitionBy("job_id").orderBy(order)


# ---- aggregates ---------------------------------------------------------------------------------


def text_stats(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    counted = df.select(by, T.word_count(F.col(text)).cast("bigint").alias("w"), F.length(text).cast("bigint").alias("c"))
    return counted.groupBy(by).agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.sum("c").alias("chars"), (F.sum("w") / T.WORDS_PER_MINUTE).alias("est_minutes"), F.avg("w").alias("avg_words"))


def completion(df: DataFrame, done: Column, by: str) -> DataFrame:
    """Share done in per cent."""
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(done).alias("completed")).withColumn("percent", F.col("completed") / F.greatest("total", F.lit(1)) * 100)


def job_timeline(events: DataFrame) -> DataFrame:
    """First and last checkpoint in the log's order, and the time between."""
    ends = events.groupBy("job_id").agg(F.min_by("ts", "ord").alias("started"), F.max_by("ts", "ord").alias("latest"))
    return ends.withColumn("elapsed_s", D.seconds_between(F.col("started"), F.col("latest")))


def parsed(events: DataFrame) -> DataFrame:
    return events.withColumn("section", T.checkpoint_section(F.col("type"))).withColumn("action", T.checkpoint_action(F.col("type")))


def section_state(events: DataFrame, totals: DataFrame) -> DataFrame:
    """The log folded to completed, current and remaining sections and files, for jobs with a total.
    Everything is a partial aggregate of the job's rows; nothing is folded in order."""
    p, action = parsed(events), F.col("action")
    moves = action.isin(*CURRENT_ACTIONS, "COMPLETE")
    file_of = lambda step: F.struct(F.concat(F.lit("section_"), F.col("section").cast("string"), F.lit(f"_{step}")).alias("key"), F.format_string(f"sections/section_%03d_{step}.wav", F.col("section")).alias("path"))
    folded = p.groupBy("job_id").agg(
        F.array_sort(F.collect_set(F.when(action == "COMPLETE", F.col("section")))).alias("completed"),
        F.max_by(F.when(action == "COMPLETE", F.lit(None)).otherwise(F.col("section")), F.when(moves, F.col("ord"))).alias("current"),
        F.array_sort(F.collect_set(F.when(action == "TTS_COMPLETE", file_of("tts")).when(action == "RVC_COMPLETE", file_of("rvc")))).alias("files"),
    )
    met = totals.filter("total > 0").join(folded, "job_id")
    remaining = F.array_except(F.sequence(F.lit(1), F.col("total")), F.col("completed"))
    remaining = F.when(F.col("current").isNotNull(), F.array_union(remaining, F.array("current"))).otherwise(remaining)
    return met.withColumn("remaining", F.array_sort(remaining))


def cost_summary(chunks: DataFrame, by: str, text: str = "text", warn_above: float = 1.0) -> DataFrame:
    """Chunks with ``usd_per_million``: characters, cost and whether it is above the limit."""
    sums = chunks.groupBy(by).agg(F.sum(F.length(text)).alias("chars"), F.sum(F.length(text) / 1e6 * F.col("usd_per_million")).alias("usd"))
    return sums.withColumn("warn", F.col("usd") > warn_above)


def success_rate(chunks: DataFrame, ok: Column, by: str) -> DataFrame:
    sums = chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.count_if(ok).alias("generated"))
    return sums.withColumn("percent", F.when(F.col("chunks") == 0, 0.0).otherwise(F.col("generated") / F.col("chunks") * 100))


def dictionary_hits(df: DataFrame, pairs: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """How often each word of the dictionary is met, counted before it is replaced, later words in what
    earlier ones left. Where the words are independent that is what stands in the text: matches of one
    pattern are counted by word, and words without any are added."""
    if T.independent(pairs):
        met = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(T.any_of(pairs)), F.lit(0))).alias("m")).groupBy(T.folded_word(F.col("m")).alias("form")).agg(F.count("*").alias("n"))
        listed = df.sparkSession.createDataFrame([(word, word.upper().lower()) for word, _ in pairs], "word string, form string")
        return listed.join(met, "form", "left").select("word", F.coalesce("n", F.lit(0)).alias("hits"))
    entries = F.array(*[F.struct(F.lit(rf"(?iU)\b{T.quoted(word)}\b").alias("word"), F.lit(reading.replace("$", r"\$")).alias("reading")) for word, reading in pairs])
    start = lambda t: F.struct(t.alias("now"), F.array().cast("array<int>").alias("hits"))

    def step(s: Column, e: Column) -> Column:
        return F.struct(F.regexp_replace(s["now"], e["word"], e["reading"]).alias("now"), F.concat(s["hits"], F.array(F.regexp_count(s["now"], e["word"]))).alias("hits"))

    met = df.filter(F.col(text).rlike(T.any_of(pairs))).select(F.aggregate(entries, start(F.col(text)), step, lambda s: s["hits"]).alias("hits"))
    wide = met.agg(*[F.coalesce(F.sum(F.get("hits", F.lit(i))), F.lit(0)).alias(f"n{i}") for i in range(len(pairs))])
    pairs_of = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"n{i}").alias("hits")) for i, (w, _) in enumerate(pairs)]))
    return wide.select(pairs_of.alias("p")).select("p.*")


def attempt_outcome(attempts: DataFrame, by: list[str]) -> DataFrame:
    ok = F.col("ok")
    return attempts.groupBy(*by).agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("succeeded"), F.min(F.when(ok, F.col("attempt"))).alias("first_ok"), F.max("attempt").alias("tried"))


def step_durations(events: DataFrame) -> DataFrame:
    """Mean and total time of each category of checkpoint, by job and run."""
    timed = run_segments(checkpoint_durations(events)).withColumn("category", T.checkpoint_category(F.col("type")))
    return timed.filter("seconds is not null").groupBy("job_id", "run", "category").agg(F.count("*").alias("steps"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"))


# ---- windows ------------------------------------------------------------------------------------


def checkpoint_durations(events: DataFrame, long: int = LONG) -> DataFrame:
    """``seconds`` since the checkpoint before, and its reading: ``Start`` for the first, ``Unknown``
    where a time is missing. Jobs of more than ``long`` events are timed in stretches, which hand on
    the last time."""

    def tell(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.max_by("ts", "ord").alias("_ts"))

    def carry(told: DataFrame, w: WindowSpec) -> DataFrame:
        return told.select("job_id", "_stretch", F.lag("_ts").over(w).alias("_last"), F.when(F.row_number().over(w) > 1, True).alias("_later"))

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_n", F.row_number().over(w))
        before = F.when(F.col("_n") == 1, F.col("_last")).otherwise(F.lag("ts").over(w))
        timed = rows.withColumn("seconds", D.seconds_between(before, F.col("ts")))
        first = (F.col("_n") == 1) & F.col("_later").isNull()
        return timed.withColumn("duration", F.when(first, "Start").otherwise(F.coalesce(D.human_duration(F.col("seconds")), F.lit("Unknown")))).drop("_n")

    return running(events, ["job_id"], ["ord"], tell, carry, add, long)


def chapter_end_pages(toc: DataFrame, book: str = "book", pages: str = "n_pages") -> DataFrame:
    w = W.partitionBy(book).orderBy("number")
    return toc.withColumn("end_page", F.coalesce(F.lead("start_page").over(w) - 1, F.col(pages)))


def rolling_eta(steps: DataFrame, remaining: Column, in_progress: bool = False, steps_kept: int = 3, long: int = LONG) -> DataFrame:
    """Mean of the last step times, for what remains after each step (one less while one is running).
    Jobs of more than ``long`` steps are gone through in stretches, which hand on their last times."""
    left = remaining - 1 if in_progress else remaining

    def tell(rows: DataFrame, by: list[str]) -> DataFrame:
        back = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ord")))
        last = rows.select(*by, "seconds", back.alias("_back")).filter(F.col("_back") <= F.greatest(F.lit(steps_kept - 1), F.lit(1)))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col("seconds").cast("double").alias("s"))))
        return last.groupBy(*by).agg(F.transform(listed, lambda x: F.struct(x["s"].alias("s"))).alias("_tail"))

    def carry(told: DataFrame, w: WindowSpec) -> DataFrame:
        seen = F.flatten(F.collect_list("_tail").over(w.rowsBetween(min(1 - steps_kept, -1), -1)))
        return told.select("job_id", "_stretch", F.when(F.row_number().over(w) > 1, seen).alias("_seen"))

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(1 - steps_kept, 0)
        own = rows.withColumn("_short", steps_kept - F.row_number().over(w)).withColumn("_sum", F.sum("seconds").over(frame)).withColumn("_count", F.count("seconds").over(frame))
        # what the frame lacks of its rows stands at the end of what was seen before
        from_before = F.filter(F.slice("_seen", -F.least("_short", F.size("_seen")), F.col("_short")), lambda x: x["s"].isNotNull())
        lacks = (F.col("_short") > 0) & (F.size("_seen") > 0)
        total = F.coalesce("_sum", F.lit(0.0)) + F.when(lacks, F.aggregate(from_before, F.lit(0.0), lambda a, x: a + x["s"])).otherwise(0.0)
        count = F.col("_count") + F.when(lacks, F.size(from_before)).otherwise(0)
        out = own.withColumn("eta_s", F.when(count > 0, total / count) * left).drop("_short", "_sum", "_count")
        return out.withColumn("eta", F.when(left <= 0, "complete!").when(F.col("eta_s").isNull(), "calculating...").otherwise(D.human_duration(F.col("eta_s"), whole=True)))

    return running(steps, ["job_id"], ["ord"], tell, carry, add, long)


def timeline(chunks: DataFrame, by: str, order: str, duration: Column, gap: Column, long: int = LONG) -> DataFrame:
    """Where each part starts: the time of the parts and gaps before it. Groups of more than ``long``
    parts are summed in stretches."""

    def tell(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(duration + gap).alias("_time"))

    def carry(told: DataFrame, w: WindowSpec) -> DataFrame:
        return told.select(by, "_stretch", F.sum("_time").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        own = F.sum(duration + gap).over(w.rowsBetween(W.unboundedPreceding, -1))
        return rows.withColumn("start_s", F.coalesce(own, F.lit(0.0)) + F.coalesce("_before", F.lit(0.0)))

    return running(chunks, [by], [order], tell, carry, add, long)


def ranges_of(numbers: Column) -> Column:
    """A rising array 1, 2, 3, 5, 6 as ``1-3_5-6``: a run begins where the number before is not one less,
    and ends where the next is not one more."""
    at = lambda i: F.get(numbers, i)
    firsts = F.filter(numbers, lambda x, i: (i == 0) | (at(i - 1) != x - 1))
    lasts = F.filter(numbers, lambda x, i: (i == F.size(numbers) - 1) | (at(i + 1) != x + 1))
    runs = F.zip_with(firsts, lasts, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    return F.array_join(runs, "_")


def number_sets(df: DataFrame, key: str, n: str) -> DataFrame:
    """The different numbers of each key, as a rising array ``numbers``; empty where all are null. Numbers
    are bits of 64-bit words, merged by ``bit_or`` before anything is shuffled, so a number that is repeated
    a million times leaves its task once."""
    word, bit = F.shiftright(F.col(n).cast("bigint"), 6), F.col(n).cast("bigint").bitwiseAND(F.lit(63)).cast("int")
    words = df.groupBy(key, word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    listed = words.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "_bits")))).alias("_words"))
    bits = F.sequence(F.lit(0), F.lit(63))
    spread = F.transform("_words", lambda w: F.transform(F.filter(bits, lambda i: F.getbit(w["_bits"], i) == 1), lambda i: w["_word"] * 64 + i))
    return listed.select(key, F.flatten(spread).alias("numbers"))


def compact_ranges(df: DataFrame, key: str, n: str, every: DataFrame | None = None) -> DataFrame:
    """1, 2, 3, 5, 6 become ``batch1-3_5-6``; keys of ``every`` without numbers, and keys whose numbers are
    null, become ``complete``."""
    sets = number_sets(df, key, n)
    if every is not None:
        sets = every.select(key).distinct().join(sets, key, "left")
    return sets.select(key, F.when(F.size("numbers") > 0, F.concat(F.lit("batch"), ranges_of(F.col("numbers")))).otherwise("complete").alias("batch"))


def batch_names(df: DataFrame, jobs: DataFrame, key: str, n: str, project: str) -> DataFrame:
    """Rows ``(project, key, batch, batch_name)`` for all of ``jobs``: the name of a job's sections, and the
    name that is still free in its project when jobs come in the order of their keys."""
    named = jobs.select(project, key).join(compact_ranges(df, key, n, jobs), key)
    return suffix_collisions(named, "batch", key, [project]).withColumnRenamed("unique_name", "batch_name")


def rewind(events: DataFrame, k: Column) -> DataFrame:
    """Events up to ordinal ``k`` of each job, where 0 <= k <= n-2; a job whose k is not valid keeps all.
    ``removed`` counts what goes, ``next`` names what the job does then."""
    n = F.count("*").over(W.partitionBy("job_id"))
    valid = (k >= 0) & (k <= n - 2)
    cut = F.when(valid, k).otherwise(n - 1)
    last = F.max_by("type", "ord").over(W.partitionBy("job_id"))
    kept = events.withColumn("removed", n - 1 - cut).withColumn("_cut", cut).filter(F.col("ord") <= F.col("_cut")).drop("_cut")
    return kept.withColumn("next", T.next_action(last))


def halt_at_first_failure(chunks: DataFrame, by: str, order: str, failed: Column, policy: str = "halt") -> DataFrame:
    """``halt``: what stands before the first failure; ``skip_failed``: successes; ``all_or_nothing``:
    nothing of a job with a failure."""
    if policy == "skip_failed":
        return chunks.filter(~failed)
    w = W.partitionBy(by)
    frame = w.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow) if policy == "halt" else w
    return chunks.withColumn("_bad", F.max(failed.cast("int")).over(frame)).filter("_bad = 0").drop("_bad")


def run_segments(events: DataFrame, start: str = "PIPELINE_START", long: int = LONG) -> DataFrame:
    """Numbers the runs of a job; the second of two starts in a row is dropped. Jobs of more than ``long``
    events are numbered in stretches, which hand on their last type and the runs so far."""
    begins = F.coalesce(F.col("type") == start, F.lit(False))

    def alone(rows: DataFrame, w: WindowSpec, last: Column) -> DataFrame:
        """``_double``: whether a row is a start after a start, ``last`` before the first row."""
        before = F.when(F.row_number().over(w) == 1, last).otherwise(F.lag(begins).over(w))
        return rows.withColumn("_double", begins & F.coalesce(before, F.lit(False)))

    def tell(rows: DataFrame, by: list[str]) -> DataFrame:
        met = alone(rows, W.partitionBy(*by).orderBy("ord"), F.lit(False))
        return met.groupBy(*by).agg(F.count_if(begins & ~F.col("_double")).alias("_runs"), F.min_by(begins, "ord").alias("_opens"), F.max_by(begins, "ord").alias("_closes"))

    def carry(told: DataFrame, w: WindowSpec) -> DataFrame:
        told = told.withColumn("_last", F.lag("_closes").over(w))
        # a stretch that opens with the second of two starts has counted it
        told = told.withColumn("_runs", F.col("_runs") - (F.col("_opens") & F.coalesce("_last", F.lit(False))).cast("int"))
        return told.select("job_id", "_stretch", "_last", F.sum("_runs").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        kept = alone(rows, w, F.col("_last")).filter("not _double").drop("_double")
        return kept.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(w) + F.coalesce("_before", F.lit(0)))

    return running(events, ["job_id"], ["ord"], tell, carry, add, long)


def latest_output(files: DataFrame, priority: Column) -> DataFrame:
    """Of each folder the newest file of the first pattern that has any."""
    ranked = files.withColumn("priority", priority).filter("priority is not null")
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy("dir").orderBy("priority", F.desc("mtime"), "path"))).filter("_n = 1").drop("_n")


def primary_sample(files: DataFrame, by: str = "dir") -> DataFrame:
    return files.groupBy(by).agg(F.min_by("path", F.struct(F.lower("name"), F.col("path"))).alias("path"))


def top_by_group(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


# ---- configuration --------------------------------------------------------------------------------


def resolve_layers(config: DataFrame) -> DataFrame:
    """The value of the highest layer for each job, section and key; a null counts as a value. Of rows of
    one layer that of the least ``place`` holds, if there is such a column, else the greatest value, so that
    each run gives the same."""
    tie = -F.col("place") if "place" in config.columns else F.col("value")
    order = F.when(F.col("layer").isNotNull(), F.struct(F.col("layer"), tie.alias("tie")))
    return config.groupBy("job_id", "section", "key").agg(F.max_by("value", order).alias("value"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys on which two jobs' settings differ, or that one of them lacks."""
    left, right = a.select("section", "key", F.col("value").alias("value_a"), F.lit(True).alias("in_a")), b.select("section", "key", F.col("value").alias("value_b"), F.lit(True).alias("in_b"))
    met = left.join(right, ["section", "key"], "full_outer")
    differs = ~F.col("value_a").eqNullSafe(F.col("value_b")) | F.col("in_a").isNull() | F.col("in_b").isNull()
    return met.filter(differs).select("section", "key", "value_a", "value_b", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def config_diffs(config: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows ``(job_a, job_b, section, key, value_a, value_b, in_a, in_b)``: on which settings the jobs of each
    pair differ. Only jobs of a pair are resolved: the layers of others end at a semi-join. The settings of
    both jobs of a pair meet in one aggregate by pair, section and key."""
    sides = pairs.select("job_a", "job_b").distinct().select("job_a", "job_b", F.explode(F.array(F.struct(F.col("job_a").alias("job_id"), F.lit(True).alias("is_a")), F.struct(F.col("job_b").alias("job_id"), F.lit(False).alias("is_a")))).alias("s")).select("job_a", "job_b", "s.*")
    resolved = resolve_layers(config.join(sides.select("job_id").distinct(), "job_id", "left_semi"))
    is_a = F.col("is_a")
    met = resolved.join(sides, "job_id").groupBy("job_a", "job_b", "section", "key").agg(
        F.max(F.when(is_a, F.col("value"))).alias("value_a"), F.max(F.when(~is_a, F.col("value"))).alias("value_b"), F.bool_or(is_a).alias("in_a"), F.bool_or(~is_a).alias("in_b")
    )
    return met.filter(~F.col("value_a").eqNullSafe(F.col("value_b")) | ~F.col("in_a") | ~F.col("in_b"))


def settings_digest(config: DataFrame) -> DataFrame:
    """Rows ``(job_id, digest)``: equal digests for jobs with the same settings, whatever layers they came
    from. Each setting's SHA-256 is cut in two halves that are added up, so order does not matter and
    nothing is gathered."""
    each = F.sha2(F.concat_ws("\x1f", "section", "key", F.when(F.col("value").isNull(), "0").otherwise(F.concat(F.lit("1"), "value"))), 256)
    half = lambda at: F.sum(F.conv(F.substring(each, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = resolve_layers(config).groupBy("job_id").agg(half(1).alias("a"), half(16).alias("b"), F.count("*").alias("n"))
    return sums.select("job_id", F.concat_ws("-", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


def changed_jobs(config: DataFrame, jobs: DataFrame, project: str, long: int = LONG) -> DataFrame:
    """Pairs ``(project, job_a, job_b)`` of jobs that follow one another in their project, by id, and whose
    settings differ: digests tell, so settings are compared only for these (``config_diffs``). A job
    without settings has none that are equal to another's."""
    told = jobs.select(project, "job_id").join(settings_digest(config), "job_id", "left").withColumn("digest", F.coalesce("digest", F.lit("none")))

    def tell(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.max_by(F.struct("job_id", "digest"), "job_id").alias("_end"))

    def carry(ends: DataFrame, w: WindowSpec) -> DataFrame:
        return ends.select(project, "_stretch", F.lag("_end").over(w).alias("_last"))

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("_before", F.coalesce(F.lag(F.struct("job_id", "digest")).over(w), F.col("_last")))

    met = running(told, [project], ["job_id"], tell, carry, add, long)
    return met.filter(F.col("_before.digest") != F.col("digest")).select(project, F.col("_before.job_id").alias("job_a"), F.col("job_id").alias("job_b"))


def config_value(json: Column, path: str, required: bool = False) -> Column:
    """The value at a dotted path; null, or an error if it is required, where it is absent."""
    got = F.get_json_object(json, f"$.{path}")
    return F.coalesce(got, F.raise_error(F.lit(f"missing configuration: {path}")).cast("string")) if required else got


def list_profiles(config: DataFrame, prefix: str = "rvc_") -> DataFrame:
    """Sections that are profiles, their names without the prefix, and their model."""
    own = config.filter(F.col("section").startswith(prefix) & (F.col("section") != f"{prefix}global"))
    model = F.max(F.when(F.col("key") == "model", F.col("value")))
    return own.groupBy("job_id", "section").agg(F.coalesce(model, F.lit("Unknown")).alias("model")).select("job_id", F.substr("section", F.lit(len(prefix) + 1)).alias("profile"), "model")


def generation_params(base: Column, config: Column, accepted: list[str] | None = None) -> Column:
    """The base map, with keys of the configuration that it lacks and that are not null, of which the
    accepted stay."""
    more = F.map_filter(config, lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(base), k))
    out = F.map_concat(base, more)
    return F.map_filter(out, lambda k, v: k.isin(*accepted)) if accepted is not None else out
