"""WARC archives whose records are Zstandard frames that share one embedded dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each frame
after it is one record; an empty skippable frame ends it. The dictionary is trained from records of the
archive itself, so an archive can be read alone, and any record by decompressing its own frame.

Spark writes and reads the files, so they may lie wherever Spark's own files may, and its commit
protocol keeps those of a task that was run twice from being doubled.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import new_folder, slices

MAGIC = 0x184D2A5D
#: An empty skippable frame: all of its bytes are ASCII, so Spark's text writer can put it after an
#: archive as what it calls a line separator.
END = "P*M\x18\0\0\0\0"
#: Bytes of payload in an archive: what a task holds at a time.
ARCHIVE_BYTES = 32 << 20
#: The dictionary, and the records it is trained from: every k-th of the archive, up to so many bytes.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
LEVEL = 6
#: Bytes of html that are held as Python strings at a time, beside the archive.
SLICE_BYTES = 4 << 20
#: Payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f5a3bd0-52c1-4b39-9d3c-7c1a0f6e2b11")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    return "".join(url.split()) or None if url else None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """A response with its HTTP head and payload, or a revisit that names the response."""
    common = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("X-Page-Id", page_id), ("X-Payload-Length", len(payload))]
    if is_revisit:
        return _record("revisit", [*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to)], b"")
    return _record("response", [*common, ("Content-Type", "application/http; msgtype=response")], _HTTP % len(payload) + payload)


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict | None:
    """None where the records are too few or too alike to train from: the archive then has an empty
    dictionary frame."""
    step = max(1, -(-sum(map(len, records)) // sample))
    chosen = records[::step]
    if len(chosen) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, chosen)) // 4), chosen, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The frames of an archive, the dictionary's first."""
    trained = train_dictionary(records)
    raw = trained.as_bytes() if trained else b""
    yield struct.pack("<II", MAGIC, len(raw)) + raw
    compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True) if trained else zstandard.ZstdCompressor(level=level, write_checksum=True)
    for r in records:
        yield compressor.compress(r)


def read_archive(stream, chunk: int = 64 << 10) -> Iterator[bytes]:
    """The records of an archive, one frame after another; no more than a record and a chunk is held."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = stream.read(size)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        rest = rest if len(rest) >= 8 else rest + stream.read(chunk)
        if not rest or rest == END.encode():
            return
        frame, out = decompressor.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Rows ``(page_id, url, html, digest, first_id, revisit)``: of equal payloads of at least
    ``revisit_from`` bytes the row with the largest page_id is the response, the others revisit it.

    Digests are counted before pages meet them; only digests that occur more than once are joined
    back, and AQE splits the pages of a hot one."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("bigint"))
    shared = rows.filter(F.col("bytes") >= revisit_from).groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    met = rows.join(shared, ["digest", "bytes"], "left")
    return met.select("page_id", "url", "html", "digest", "first_id", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: datetime | None = None) -> DataFrame:
    """Writes a record for every row of ``pages`` and returns the archives' ``(path, length)``.

    Every archive holds up to ``archive_bytes`` of payload and one page beyond, whatever the page's
    size, and is a file of its own in ``folder``, any that Spark can write to.

    Null html is an empty payload; a null url has no target header; null page_ids are records
    without that header. Rows that repeat the response's page_id and payload are responses as well.
    An empty table gives no archives; other columns are not read.
    """
    stamp = (date or datetime(2024, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def tasks(batches):
        held: list[bytes] = []
        size = 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(archive(held))], pa.binary())], names=["content"])

        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                for page_id, url, html, digest, first_id, revisit in zip(*(c.to_pylist() for c in part.columns)):
                    payload = html.encode("utf-8", "surrogatepass")
                    held.append(page_record(page_id, url, payload, bytes.fromhex(digest), first_id, revisit, stamp))
                    size += len(payload) + 512
                    if size >= archive_bytes:
                        yield made()
                        held, size = [], 0
        if held:
            yield made()

    archives = decide(pages, id_col, url_col, html_col).sortWithinPartitions("page_id").mapInArrow(tasks, "content binary")
    # bytes pass through the text writer as they are
    archives.select(F.col("content").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(folder)
    return archives_in(pages.sparkSession, folder).select("path", "length")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """Rows ``(path, modificationTime, length, content)``, one for each archive."""
    return spark.read.format("binaryFile").load(folder).filter("length > 0")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows ``(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri)`` of every
    record of the archives (column ``content``). Archives are dealt over tasks as Spark deals files; a
    response's length and digest are those of the payload read, and it is an error if its headers say
    otherwise."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]

    def one(record: bytes) -> tuple:
        headers, block = parse_record(record)
        kind, told = headers["WARC-Type"], base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        length = int(headers["X-Payload-Length"])
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if (len(payload), hashlib.sha1(payload).hexdigest()) != (length, told):
                raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        number = lambda name: int(headers[name]) if name in headers else None
        return number("X-Page-Id"), length, told, kind, number("X-Refers-To-Page-Id"), headers.get("WARC-Target-URI")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def tasks(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for record in read_archive(io.BytesIO(content.as_buffer())):
                    rows.append(one(record))
                    if len(rows) == 5000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return archives.select("content").mapInArrow(tasks, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archives to a new shared folder and reads them back."""
    folder = new_folder(spark, "warc")
    write_archives(pages, folder)
    return read_archives(archives_in(spark, folder))
