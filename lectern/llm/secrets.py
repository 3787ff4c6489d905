"""Secrets in texts: a keyword automaton, anchored patterns at its hits, checksums within the tokens.

A text is scanned once, as bytes in which all letters are small and all signs of a hexadecimal number
look alike, by an Aho-Corasick automaton of the keywords in the same spelling; a run of 24 hexadecimal
signs is such a keyword too. Only where one is met a regular expression is tried, anchored there, on the
bytes as they are. Formats that carry a checksum of themselves count where it is right.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pii import joined, redacted
from .shared import slices

#: Bytes of text that are held as Python strings at a time.
SLICE_BYTES = 2 << 20
Span = tuple[str, int, int]

# ---- checksums -----------------------------------------------------------------------------------

# The alphabets of the formats, and the generator of Bech32.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _number(text: str, alphabet: str) -> int:
    out = 0
    for sign in text:
        out = out * len(alphabet) + alphabet.index(sign)
    return out


def crc_base62(token: str) -> bool:
    """The last six signs after the prefix are the CRC-32 of those before, in base 62."""
    body = token.partition("_")[2]
    return _number(body[-6:], BASE62) == zlib.crc32(body[:-6].encode())


def base58_check(token: str) -> bool:
    """The last four bytes are the first of a double SHA-256 of those before."""
    raw = _number(token, BASE58).to_bytes(82, "big") if len(token) == 111 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(token: str) -> bool:
    """The polynomial of the prefix and of all signs leaves one."""
    head, _, body = token.lower().rpartition("1")
    check = 1
    for value in [*(ord(c) >> 5 for c in head), 0, *(ord(c) & 31 for c in head), *map(BECH32.index, body)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for i, generator in enumerate(BECH32_GENERATOR):
            check ^= generator if top >> i & 1 else 0
    return check == 1


# ---- formats -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Format:
    """A kind of secret: keywords with which each match begins, in the spelling of the text; the pattern,
    anchored at a keyword; what a match must pass; and whether it is a base kind."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    passes: Callable[[re.Match], bool]
    base: bool = False


def _whole(check: Callable[[str], bool]) -> Callable[[re.Match], bool]:
    return lambda m: check(m.group().decode("ascii"))


#: Base kinds first, in their order; then those with a checksum. No match of a kind is longer than its
#: pattern's run of signs, and no two keywords of a kind begin at the same place.
FORMATS = (
    Format("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), lambda m: m.end() - m.start(1) >= 6, True),
    Format("access", ("AKIA",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20, True),
    Format("hex", ("0" * 24,), re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= 24, True),
    Format("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _whole(crc_base62)),
    Format("npm", ("npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _whole(crc_base62)),
    Format("xprv", ("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), _whole(base58_check)),
    Format("age", ("AGE-SECRET-KEY-1",), re.compile(rb"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![A-Za-z0-9])"), _whole(bech32_check)),
    Format("nsec", ("nsec1",), re.compile(rb"nsec1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{58}(?![A-Za-z0-9])"), _whole(bech32_check)),
)
KINDS = tuple(f.kind for f in FORMATS)
BASE = tuple(f.kind for f in FORMATS if f.base)

#: Large letters as small ones, then hexadecimal signs as 0.
_FOLD = bytes(48 if (low := c + 32 if 65 <= c <= 90 else c) in b"0123456789abcdef" else low for c in range(256))


def folded(raw: bytes) -> bytes:
    return raw.translate(_FOLD)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Keywords as folded, with their length and the formats that may begin there. Two formats whose
    keywords fold alike share an entry."""
    entries: dict[str, list[int]] = {}
    for n, f in enumerate(FORMATS):
        for word in f.keywords:
            kept = entries.setdefault(folded(word.encode()).decode("latin-1"), [])
            if n not in kept:
                kept.append(n)
    out = ahocorasick.Automaton()
    for word, formats in entries.items():
        out.add_word(word, (len(word) - 1, tuple(formats)))
    out.make_automaton()
    return out


def _places(raw: bytes, ends: list[int]) -> dict[int, int]:
    """Numbers of code points before some places of a UTF-8 text, in one pass."""
    if raw.isascii():
        return {n: n for n in ends}
    out, at, count = {}, 0, 0
    for n in sorted(set(ends)):
        count += len(raw[at:n].decode("utf-8"))
        at = n
        out[n] = count
    return out


def find_spans(text: str) -> list[Span]:
    """Spans by start, then kind in the order of ``KINDS``, in code points, ends exclusive. Within a kind
    they are the leftmost matches that do not overlap and pass their test; a match that fails is dropped,
    and none is sought within it."""
    raw = text.encode()
    found: list[tuple[int, int, int]] = []
    done = [0] * len(FORMATS)
    # no keyword of a kind lies within another, so a kind's hits come by their beginnings
    for end, (back, formats) in automaton().iter(folded(raw).decode("latin-1")):
        start = end - back
        for n in formats:
            if start >= done[n] and (m := FORMATS[n].pattern.match(raw, start)):
                done[n] = m.end()
                if FORMATS[n].passes(m):
                    found.append((start, n, m.end()))
    place = _places(raw, [x for start, _, end in found for x in (start, end)])
    return [(KINDS[n], place[start], place[end]) for start, n, end in sorted(found)]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one for each row.

    Counts and hash are of the base spans, ``spans`` lists all; spans of different kinds may overlap (a
    token with a right checksum may be what is assigned). Null and empty texts have none; the hash is then
    of the empty string. Very long texts are scanned whole, in linear time, and held one at a time. Of
    spans that start together the kinds come in the order of ``KINDS``. Repeated rows and repeated or null
    doc_ids are rows of their own; an empty table gives none; other columns are not read. No shuffle.
    """
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def tasks(batches):
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                every = [find_spans(t or "") for t in part.column(1).to_pylist()]
                base = [[s for s in spans if s[0] in BASE] for spans in every]
                counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
                digests = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([joined(spans) for spans in every], pa.string())], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in its text replaced by their kinds; all other columns as they were.

    Null and empty texts stay; very long ones are replaced whole. Of spans that overlap, the first by
    start, then kind, is named, and what the others reach beyond it goes as well. Repeated rows stay rows
    of their own; an empty table stays empty; the names of other columns cannot clash."""

    @F.pandas_udf("string")
    def clean(text):
        import pandas as pd

        out: list[str | None] = []
        for part in slices(pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"]), 0, SLICE_BYTES):
            out += [None if t is None else redacted(t, find_spans(t)) for t in part.column(0).to_pylist()]
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
