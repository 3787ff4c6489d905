"""Reading and writing texts, checkpoints, configuration snapshots and assets."""

from __future__ import annotations

import html.entities
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from .scratch import local_folder

SOURCE_SUFFIXES = (".txt", ".epub", ".pdf")
AUDIO_SUFFIXES = (".wav", ".mp3", ".flac", ".m4a", ".ogg")
CHECKPOINT = "timestamp string, type string, message string"
PROGRESS = (
    "project string, created string, paths map<string,string>, phases map<string,struct<complete:boolean,completed_at:string,data:string>>, "
    "sections struct<total:int,completed:array<int>,current:int,remaining:array<int>,files:map<string,string>>, "
    f"checkpoints array<struct<timestamp:string,type:string,message:string>>"
)


#: Rows that a task on texts should have at most, on average.
TASK_ROWS = 10_000


def spread(df: DataFrame, bounded: bool = True) -> DataFrame:
    """Deals an input of fewer files than cores, or of large files, in tasks of a bounded number of rows:
    work on texts is heavy by the row, while a reader gives a file, or a large stretch of one, to one task. Rows
    are counted from the files' footers. Tables of many small files stay where they are, unshuffled, and unless
    ``bounded`` all that have a file for each core: large tasks may be better than a shuffle of all texts."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    tasks = max(cores, -(-df.count() // TASK_ROWS)) if bounded else cores
    return df.repartition(tasks) if files < tasks else df


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are that, else Latin-1, which any bytes are; stripped."""
    return T.strip_edges(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")))


def read_text_corpus(spark: SparkSession, glob: str, recursive: bool = False) -> DataFrame:
    """Rows ``(path, text)``, one for each file; with ``recursive`` those in folders below as well."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(glob).select("path", decode_text(F.col("content")).alias("text"))


# All names of HTML5 with their signs, the old ones among them that need no semicolon, and
# code points that do not stand for themselves.
NAMES = html.entities.html5
OLD_NAMES = sorted((name for name in NAMES if not name.endswith(";")), key=len, reverse=True)
ODD_CODES = {n: sign for n in (*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | q for p in range(17) for q in (0xFFFE, 0xFFFF))) if (sign := html.unescape(f"&#{n};")) != chr(n)}
REFERENCE = r"\A(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: References that most pages have, looked for before the table.
COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "#39;", "apos;", "copy;", "middot;", "ndash;", "mdash;", "hellip;", "rsquo;", "lsquo;", "rdquo;", "ldquo;")
#: Lists that names and odd codes are dealt to by a hash, so that one is sought among a few.
LISTS = 1024


def _listed() -> str:
    """The table as one string: lists parted by 03, entries by 02, name and sign by 01."""
    lists: list[list[str]] = [[] for _ in range(LISTS)]
    for name, sign in {**NAMES, **{f"#{n}": sign for n, sign in ODD_CODES.items()}}.items():
        lists[zlib.crc32(name.encode()) % LISTS].append(f"{name}\x01{sign}")
    return "\x03".join("\x02".join(entries) for entries in lists)


def _known(name: Column) -> Column:
    """The sign of a name or of an odd code written ``#n``; null for others. The lists are a constant array."""
    lists = F.split(F.lit(_listed()), "\x03")
    return F.try_element_at(F.str_to_map(F.get(lists, F.pmod(F.crc32(name.cast("binary")), F.lit(LISTS)).cast("int")), F.lit("\x02"), F.lit("\x01")), name)


def _sign_of(reference: Column) -> Column:
    """What one character reference, without the sign & before it, stands for; null for none."""
    digits = F.regexp_extract(reference, r"^#[xX]?0*([0-9a-fA-F]*?);?$", 1)
    base = lambda n: F.conv(F.concat(F.lit("0"), digits), n, 10).cast("int")
    code = F.when(F.length(digits) > 7, 0x110000).when(reference.rlike("^#[xX]"), base(16)).otherwise(base(10))
    no_sign = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    number = F.when(no_sign, "\ufffd").otherwise(F.coalesce(_known(F.concat(F.lit("#"), code.cast("string"))), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
    old = F.regexp_extract(reference, f"^(?:{'|'.join(OLD_NAMES)})", 0)
    name = F.coalesce(_known(reference), F.when(old != "", F.concat(_known(old), F.substr(reference, F.length(old) + 1))))
    return F.when(reference.startswith("#"), number).otherwise(name)


def _decoded(piece: Column) -> Column:
    """What follows a sign &, with the reference that it begins with, if any, as its sign."""
    reference = F.regexp_extract(piece, REFERENCE, 0)
    sign = F.when(reference != "", _sign_of(reference))
    out = F.when(sign.isNotNull(), F.concat(sign, F.substr(piece, F.length(reference) + 1))).otherwise(F.concat(F.lit("&"), piece))
    for name in reversed(COMMON):
        out = F.when(piece.startswith(name), F.concat(F.lit(html.unescape(f"&{name}")), F.substr(piece, F.lit(len(name) + 1)))).otherwise(out)
    return out


def decode_references(text: Column) -> Column:
    """Named, decimal and hexadecimal character references as their signs, as ``html.unescape`` has
    them, in one pass from left to right: what a reference gives is not read again. A text is cut at its
    signs &; what stands before the first is none."""
    return F.array_join(F.transform(F.split(text, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(_decoded(piece))), "")


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, the title stays; tags part no words.
    Lines and double spaces become single spaces."""
    for pattern in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->", r"(?i)<!doctype[^>]*>", r"(?s)</?[A-Za-z][^>]*>"):
        html = F.regexp_replace(html, pattern, "")
    parts = F.flatten(F.transform(F.split(decode_references(html), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: F.split(T.strip_edges(line), "  ")))
    return F.array_join(F.filter(F.transform(parts, T.strip_edges), lambda p: p != ""), " ")


def assemble_document(parts: DataFrame, doc: str, ordinal: str, text: str) -> DataFrame:
    """Parts that are not blank, joined by a space in order. Documents without any are left out;
    ``rejected_documents`` names them."""
    kept = parts.filter(T.strip_edges(F.col(text)) != "")
    return kept.groupBy(doc).agg(F.expr(f"listagg({text}, ' ') WITHIN GROUP (ORDER BY {ordinal})").alias(text))


def rejected_documents(parts: DataFrame, doc: str, text: str) -> DataFrame:
    return parts.groupBy(doc).agg(F.coalesce(F.bool_or(T.strip_edges(F.col(text)) != ""), F.lit(False)).alias("any")).filter("not any").select(doc)


def read_progress_logs(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """Rows ``(path, ord, timestamp, type, message)`` of the checkpoints of progress files; a file that
    is not readable as JSON gives none. With ``lines`` a file has a progress record on each line, and rows
    have its ``project`` after ``path``: a store of many jobs then has few files to list and open."""
    logs = spark.read.schema(PROGRESS).json(glob, multiLine=not lines, mode="PERMISSIVE")
    named = ["path", "project"] if lines else ["path"]
    told = logs.select(F.col("_metadata.file_path").alias("path"), "project", F.posexplode("checkpoints").alias("ord", "c"))
    return told.select(*named, "ord", "c.*")


def read_progress(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(glob, multiLine=True, mode="PERMISSIVE")


#: Parts of a list of files that a task of ``scan_assets`` has at most.
LISTED_PARTS = 64


def scan_assets(spark: SparkSession, folder: str, suffixes: Sequence[str] = AUDIO_SUFFIXES) -> DataFrame:
    """Rows ``(path, name, stem, ext, mtime, length, mb)`` of files with one of the suffixes in either
    case, by lower-case name; contents are not read. Spark deals files to tasks as if each had 4 MB to open, 32 a
    task; as none is opened here, 64 such parts are a task, which has few shuffle files to write."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("mtime"), "length")
    tasks = max(spark.sparkContext.defaultParallelism, -(-listed.rdd.getNumPartitions() // LISTED_PARTS))
    found = listed.coalesce(tasks).dropDuplicates(["path"])
    named = found.withColumn("name", base_name(F.col("path"))).withColumn("stem", stem(F.col("path"))).withColumn("ext", suffix(F.col("path")))
    return named.filter(F.col("ext").isin(*suffixes)).withColumn("mb", F.col("length") / (1024 * 1024)).orderBy(F.lower("name"))


def read_config_snapshots(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """Rows ``(path, section, key, value)``; a value that is null stays a row. Invalid JSON is an error. A
    file is a snapshot, or with ``lines`` each of its lines is one."""
    raw = spark.read.text(glob, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,map<string,string>>", {"mode": "FAILFAST"}).alias("m"))
    return raw.select("path", F.explode("m").alias("section", "keys")).select("path", "section", F.explode("keys").alias("key", "value"))


def write_clean_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def section_name(n: Column) -> Column:
    return F.format_string("section_%03d.txt", n)


#: Files that a folder of ``write_texts`` has below it, on average, and folders that it has at least: Spark lists
#: more than 32 folders in tasks, one a folder, and fewer in the driver.
FOLDER_FILES, LEAST_FOLDERS = 1000, 64


def write_texts(df: DataFrame, folder: str) -> None:
    """Each row of ``text`` as a file of its own, ended by a line feed, in a folder ``dir=`` by its ``dir``, a
    whole number. Those lie in folders ``bucket=`` by a hash of it, each from one task, so that they are
    committed and listed by the thousand.

    For each file, Hadoop's local file system starts a process three times to set its mode, which takes some
    15 ms; there the tasks write the files themselves, each under another name first. A file's name follows
    from its row, so a task that is run again writes the same files. Other stores get them by Spark's writer."""
    spark, rows = df.sparkSession, df.count()
    buckets = max(LEAST_FOLDERS, -(-rows // FOLDER_FILES))
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    dealt = df.select(F.pmod(F.xxhash64("dir"), F.lit(buckets)).cast("int").alias("bucket"), "dir", "text").repartition(tasks, "bucket")
    local = local_folder(spark, folder)
    if local is None:
        dealt.write.mode("append").option("maxRecordsPerFile", 1).option("lineSep", "\n").partitionBy("bucket", "dir").text(folder)
        return

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, number, nth, text in zip(*(c.to_pylist() for c in batch.columns)):
                place = f"{local}/bucket={bucket}/dir={'__HIVE_DEFAULT_PARTITION__' if number is None else number}"
                os.makedirs(place, exist_ok=True)
                other = f"{place}/.{uuid.uuid4().hex}"
                with open(other, "wb") as file:
                    file.write((text or b"") + b"\n")
                os.replace(other, f"{place}/part-{nth:05d}.txt")
            yield pa.record_batch({"files": [batch.num_rows]})

    nth = F.row_number().over(W.partitionBy("bucket", "dir").orderBy("text"))
    dealt.select("bucket", "dir", nth.alias("nth"), F.col("text").cast("binary")).mapInArrow(written, "files bigint").agg(F.sum("files")).collect()


def write_sections(df: DataFrame, path: str, doc: str = "doc_id", number: str = "section_no", folders: int = 256) -> None:
    """Sections with their document and name, in folders by a hash of the document, so that a document
    is found in one of them and their number does not grow with the documents."""
    named = df.withColumn("file_name", section_name(F.col(number))).withColumn("folder", F.pmod(F.xxhash64(doc), F.lit(folders)).cast("int"))
    named.repartition("folder").sortWithinPartitions("folder", doc, number).write.mode("overwrite").partitionBy("folder").parquet(path)


def read_sections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The sections again, without their folders."""
    return spark.read.schema(f"{schema}, file_name string, folder int").parquet(path).drop("folder")


# ---- filters ------------------------------------------------------------------------------------


def supported_sources(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Sources whose suffix is known, and the rest."""
    known = suffix(F.col(path)).isin(*SOURCE_SUFFIXES)
    return df.filter(known), df.filter(~F.coalesce(known, F.lit(False)))


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(T.strip_edges(F.col(text)) != "")


def usable_files(wanted: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Inputs with a column ``reason``: null where the file is there and has bytes."""
    met = wanted.join(files.select(path, "length"), path, "left")
    return met.withColumn("reason", F.when(F.col("length").isNull(), "missing").when(F.col("length") <= 0, "empty"))


def page_artifact_filter(df: DataFrame, text: str = "text", mode: str = "page") -> DataFrame:
    """Without control characters, even white space; texts of under three characters, of digits alone
    or beginning with a page number go. ``mode="line"`` applies the three rules to each line."""
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

    def keep(t: Column) -> Column:
        return (F.length(t) >= 3) & ~t.rlike(r"(?U)\A\d+\z") & ~t.rlike(rf"(?i)\A(?:page|p\.){T.WS}*\d+")

    clean = lambda t: T.strip_edges(F.regexp_replace(T.collapse_ws(t), control, ""))
    if mode == "page":
        return df.withColumn(text, clean(F.col(text))).filter(keep(F.col(text)))
    # all lines at once: signs made even within lines, lines without text worth keeping emptied, breaks made spaces
    artifact = r"(?<![^\n]) *(?:[^\n]{0,2}|(?U)\d+(?-U)|(?i:page|p\.) *[0-9][^\n]*) *(?![^\n])"
    within = T.WS.replace("\\t-\\r", "\\t\\x0b-\\r")
    even = lambda t: F.when(T.has_rare_ws(t), F.regexp_replace(t, f"{within}+", " ")).when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t)
    plain = lambda t: F.when(t.rlike(control), F.regexp_replace(t, control, "")).otherwise(t)
    kept = T.let(T.let(F.col(text), even), plain)
    kept = F.btrim(F.regexp_replace(F.regexp_replace(kept, artifact, ""), r" *\n[ \n]*", " "))
    # a row is made of the text, so that a filter on it is no second copy of the work
    made = F.explode(F.filter(F.array(kept), lambda t: t != ""))
    return df.select(*[made.alias(text) if c == text else F.col(c) for c in df.columns])


def select_ordinals(df: DataFrame, requests: DataFrame, doc: str, ordinal: str, strict: bool = False) -> DataFrame:
    """The parts whose 1-based ordinal is requested for their document, with ``request_pos``; requests
    below 1 are dropped. Requests are joined on document and ordinal. ``strict``: a request beyond the
    last part of its document is an error."""
    if strict:
        seen = requests.join(df.groupBy(doc).agg(F.count("*").alias("_total")), doc, "left")
        past = F.col("ordinal") > F.coalesce("_total", F.lit(0))
        said = F.concat_ws(" ", F.lit("part"), F.col("ordinal").cast("string"), F.lit("of document"), F.col(doc).cast("string"), F.lit("is not there"))
        requests = seen.withColumn("ordinal", F.when(past, F.raise_error(said).cast("int")).otherwise(F.col("ordinal"))).drop("_total")
    return df.join(requests.filter("ordinal >= 1").select(doc, F.col("ordinal").alias(ordinal), "request_pos"), [doc, ordinal])


def validate_ordinals(df: DataFrame, requests: DataFrame, doc: str) -> DataFrame:
    """For each document with requests: ``total`` parts, whether all requests are within 1..total, and
    the first that is not."""
    totals = df.groupBy(doc).agg(F.count("*").cast("int").alias("total"))
    seen = requests.join(totals, doc, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    bad = (F.col("ordinal") < 1) | (F.col("ordinal") > F.col("total"))
    return seen.groupBy(doc, "total").agg((~F.bool_or(bad)).alias("valid"), F.min_by(F.when(bad, F.col("ordinal")), F.when(bad, F.col("request_pos"))).alias("first_bad"))


def expand_ranges(spec: Column) -> Column:
    """``3-7`` and ``5`` in a list parted by spaces become ordinals, sorted and distinct; null if any
    part is malformed. A falling range gives none."""
    tokens = T.words(spec)
    is_range = lambda t: t.contains("-") & ~t.startswith("-")

    def numbers(t: Column) -> Column:
        ends = F.split(t, "-")
        lo, hi = F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.lit(1)).try_cast("int")
        run = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.when(is_range(t), F.when((F.size(ends) == 2) & lo.isNotNull() & hi.isNotNull(), run)).otherwise(F.when(t.try_cast("int").isNotNull(), F.array(t.try_cast("int"))))

    parts = F.transform(tokens, numbers)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_sort(F.array_distinct(F.flatten(parts))))


def jobs_needing_preprocessing(progress: DataFrame) -> DataFrame:
    done = F.coalesce(F.try_element_at("phases", F.lit("preprocessing"))["complete"], F.lit(False))
    return progress.filter(~done | (F.coalesce(F.col("sections.total"), F.lit(0)) == 0))
