"""Joins. Small sides are left to Spark's own size check, none is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

DEFAULT_PRICE = 15.0


def _covered(pages: DataFrame, ranges: DataFrame, book: str) -> DataFrame:
    """Pages within any of the ranges ``(_book, start_page, end_page)``. A range is cut at every 64th page
    into bits of a word; words of a book and place are merged, so that a page looks up one bit of one row,
    however many ranges a book has and however they overlap. Ranges end where their book does."""
    last = pages.groupBy(F.col(book).alias("_book")).agg(F.max("page_no").cast("bigint").alias("_last"))
    met = ranges.select("_book", F.col("start_page").cast("bigint").alias("_a"), F.col("end_page").cast("bigint").alias("_e")).join(last, "_book")
    met = met.select("_book", "_a", F.least("_e", "_last").alias("_b")).filter("_a <= _b")
    words = met.select("_book", "_a", "_b", F.explode(F.sequence(F.shiftright("_a", 6), F.shiftright("_b", 6))).alias("_word"))
    place = lambda n: n.cast("int")
    lo, hi = place(F.greatest(F.col("_a") - F.col("_word") * 64, F.lit(0))), place(F.least(F.col("_b") - F.col("_word") * 64, F.lit(63)))
    ones = F.lit(-1).cast("bigint")
    bits = F.call_function("shiftleft", ones, lo).bitwiseAND(F.call_function("shiftrightunsigned", ones, 63 - hi))
    kept = words.groupBy("_book", "_word").agg(F.bit_or(bits).alias("_bits"))
    at = F.shiftright(F.col("page_no").cast("bigint"), 6) == F.col("_word")
    is_in = F.getbit("_bits", F.col("page_no").cast("bigint").bitwiseAND(F.lit(63)).cast("int")) == 1
    return pages.join(kept, (F.col(book) == F.col("_book")) & at).filter(is_in).select(*pages.columns)


def pages_of_chapters(pages: DataFrame, chapters: DataFrame, wanted: DataFrame, book: str = "book") -> DataFrame:
    """Pages within a wanted chapter's first and last page."""
    ranges = chapters.join(wanted, [book, "number"]).select(F.col(book).alias("_book"), "start_page", "end_page")
    return _covered(pages, ranges, book)


def pages_wanted(pages: DataFrame, chapters: DataFrame, wanted: DataFrame, book: str = "book", strict: bool = True) -> DataFrame:
    """Pages asked for by number: numbers are those of chapters in a book that has several, and of pages
    in one that has not. There a page past the last one is an error (``strict``) or is left out."""
    several = chapters.groupBy(book).agg((F.count("*") > 1).alias("_several"))
    asked = wanted.join(several, book, "left").withColumn("_several", F.coalesce("_several", F.lit(False)))
    by_chapter = asked.filter("_several").join(chapters, [book, "number"]).select(F.col(book).alias("_book"), "start_page", "end_page")
    by_page = asked.filter("not _several").select(F.col(book).alias("_book"), F.col("number").alias("start_page"), F.col("number").alias("end_page"))
    if strict:
        total = pages.groupBy(F.col(book).alias("_book")).agg(F.max("page_no").alias("_total"))
        seen = by_page.join(total, "_book", "left")
        past = F.col("end_page") > F.coalesce("_total", F.lit(0))
        said = F.concat(F.lit("page "), F.col("end_page").cast("string"), F.lit(" of book "), F.col("_book").cast("string"), F.lit(" is not there, it has "), F.coalesce("_total", F.lit(0)).cast("string"))
        # the error is in the start of the range, which a join needs
        by_page = seen.select("_book", F.when(past, F.raise_error(said).cast("int")).otherwise(F.col("start_page")).alias("start_page"), "end_page")
    return _covered(pages, by_chapter.unionByName(by_page), book)


def pair_samples(audio: DataFrame, texts: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Audio with the stripped text of the same folder and stem; with ``keep_unmatched`` an empty one."""
    from ..functions.text import strip_edges

    told = texts.select("dir", "stem", strip_edges(F.col("text")).alias("text"))
    met = audio.join(told, ["dir", "stem"], "left" if keep_unmatched else "inner")
    return met.withColumn("text", F.coalesce("text", F.lit(""))) if keep_unmatched else met


def unmatched_samples(audio: DataFrame, texts: DataFrame) -> DataFrame:
    return audio.join(texts, ["dir", "stem"], "left_anti")


def missing_required_keys(config: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that a job lacks or has as null."""
    return required.join(config.filter(F.col("value").isNotNull()), keys, "left_anti")


def section_files(finished: DataFrame, files: DataFrame) -> DataFrame:
    """A path for each finished step: the recorded one, else the default name."""
    met = finished.join(files, ["job_id", "section", "step"], "left")
    return met.withColumn("path", F.coalesce("path", F.format_string("sections/section_%03d_%s.wav", F.col("section"), F.col("step"))))


def resolve_voice(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests ``(request_id, voice, fallback)`` against ``(catalog_pos, voice)``: the voice itself, else
    a fallback in the catalogue, else the voice as asked with the first three that begin with its language
    and region, however much of the region it names."""
    names = catalog.select("voice").distinct()
    met = requests.join(names.withColumn("found", F.lit(True)), "voice", "left")
    met = met.join(names.select(F.col("voice").alias("fallback"), F.lit(True).alias("has_fallback")), "fallback", "left")
    parts = F.split("voice", "-")
    prefix = F.when(F.size(parts) >= 2, F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise("en-")
    met = met.withColumn("prefix", prefix)
    # all beginnings of a name in the catalogue, of which those asked for stay; of each the first three
    begins = F.transform(F.sequence(F.lit(1), F.length("voice")), lambda n: F.substr("voice", F.lit(1), n))
    by_prefix = catalog.filter(F.length("voice") > 0).select("catalog_pos", "voice", F.explode(begins).alias("prefix"))
    by_prefix = by_prefix.join(met.select("prefix").distinct(), "prefix", "left_semi")
    first = by_prefix.withColumn("n", F.row_number().over(W.partitionBy("prefix").orderBy("catalog_pos"))).filter("n <= 3")
    first = first.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("catalog_pos", "voice"))), lambda x: x["voice"]).alias("suggestions"))
    met = met.join(first, "prefix", "left")
    exact, other = F.coalesce("found", F.lit(False)), F.coalesce("has_fallback", F.lit(False))
    return met.select(
        "request_id",
        F.when(exact, F.col("voice")).when(other, F.col("fallback")).otherwise(F.col("voice")).alias("voice"),
        F.when(exact, "exact").when(other, "fallback").otherwise("unverified").alias("how"),
        F.when(exact | other, F.lit(None)).otherwise(F.array_join("suggestions", ",")).alias("suggestions"),
    )


def price_join(chunks: DataFrame, prices: DataFrame, default: float = DEFAULT_PRICE) -> DataFrame:
    """Chunks with the price per million characters of their model."""
    return chunks.join(prices, "model", "left").withColumn("usd_per_million", F.coalesce("usd_per_million", F.lit(default)))


def pending_sections(jobs: DataFrame, done: DataFrame, current: DataFrame) -> DataFrame:
    """All of 1..total without those done, and the current one."""
    every = jobs.filter("total > 0").select("job_id", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("section"))
    return every.join(done, ["job_id", "section"], "left_anti").unionByName(current.filter("section is not null").select("job_id", "section")).distinct()


def unmastered_sections(events: DataFrame) -> DataFrame:
    """Sections with COMPLETE but without MASTER_COMPLETE."""
    at = lambda action: events.filter(F.col("action") == action).select("job_id", "section").distinct()
    return at("COMPLETE").join(at("MASTER_COMPLETE"), ["job_id", "section"], "left_anti")


def merge_profiles(general: DataFrame, specific: DataFrame) -> DataFrame:
    """The specific value where there is one (null included), else the general."""
    a = general.select("profile", "key", F.col("value").alias("g"))
    b = specific.select("profile", "key", F.col("value").alias("s"), F.lit(True).alias("own"))
    return a.join(b, ["profile", "key"], "full_outer").select("profile", "key", F.when(F.col("own"), F.col("s")).otherwise(F.col("g")).alias("value"))


def reconcile_files(sections: DataFrame, files: DataFrame) -> DataFrame:
    """Sections in the state and on disk: ``in_state``, ``on_disk``, and whether one is missing its file."""
    a = sections.select("job_id", "section", F.lit(True).alias("in_state"))
    b = files.select("job_id", "section", F.lit(True).alias("on_disk"))
    met = a.join(b, ["job_id", "section"], "full_outer")
    flags = met.withColumn("in_state", F.coalesce("in_state", F.lit(False))).withColumn("on_disk", F.coalesce("on_disk", F.lit(False)))
    return flags.withColumn("missing", F.col("in_state") & ~F.col("on_disk"))


def dedupe_keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def accepted_params(params: DataFrame, allowed: DataFrame) -> DataFrame:
    return params.join(allowed, "key", "left_semi")
