"""Byte-level BPE by corpus-level merge replay.

All distinct words of a run of documents stand in one sequence of symbols. An inverted index maps
each pair of symbols that can merge to the places where it stands; merges are applied in the order
of their ranks, each at all of its places, and only the pairs beside a merged place change. So the
cost follows the number of distinct words and their merges, not the number of words.

A run is what one task reads, in parts of bounded size; words met before are kept in a cache of
bounded size. No table of words is shuffled or sent to the driver, and long texts need no more than
their own symbols.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterable
from itertools import filterfalse
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .pieces import pieces, spelled
from .shared import slices

#: Pieces kept by a Python worker; beyond it only those of the last run stay.
CACHE_ENTRIES = 600_000
#: Bytes of text that are replayed together, and so held as Python strings at a time.
RUN_BYTES = 8 << 20
_SHIFT = 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file. It is read by each Python worker where the package is installed."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes distinct words together, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.merged: dict[int, int] = {}

    def _merge(self, pair: int) -> int:
        """Id of the token that a pair merges to, or -1."""
        got = self.merged.get(pair)
        if got is None:
            if len(self.merged) > 2_000_000:
                self.merged.clear()
            joined = self.tokens[pair >> _SHIFT] + self.tokens[pair & ((1 << _SHIFT) - 1)]
            got = self.merged[pair] = self.ranks.get(joined, -1)
        return got

    def alone(self, word: bytes) -> list[int]:
        """One word, always merging its lowest pair: what the replay must equal."""
        ids = [self.of_byte[b] for b in word]
        while len(ids) > 1:
            found = [(m, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := self._merge(a << _SHIFT | b)) >= 0]
            if not found:
                break
            rank, at = min(found)
            ids[at : at + 2] = [rank]
        return ids

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers; an empty word has none."""
        out: list[bytes | None] = [pack("<I", self.ranks[w]) if w in self.ranks else None for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out  # type: ignore[return-value]
        lengths = np.fromiter((len(words[i]) for i in todo), "i8", len(todo))
        starts = np.zeros(len(todo), "i8")
        np.cumsum(lengths[:-1] + 1, out=starts[1:])
        # each word is followed by -1, so that no pair crosses words
        raw = np.frombuffer(b"\0".join(words[i] for i in todo) + b"\0", "u1")
        flat = np.asarray(self.of_byte, "i8")[raw]
        flat[starts + lengths] = -1
        pair = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << _SHIFT | flat[1:], -1)
        order = np.argsort(pair, kind="stable")
        codes, first = np.unique(pair[order], return_index=True)
        index: dict[int, list[int]] = {}
        heap: list[tuple[int, int]] = []
        ends = np.append(first[1:], len(order))
        for code, lo, hi in zip(codes.tolist(), first.tolist(), ends.tolist()):
            if code >= 0 and (rank := self._merge(code)) >= 0:
                index[code] = order[lo:hi].tolist()
                heap.append((rank, code))
        heapq.heapify(heap)
        sym = flat.tolist()
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym)))
        begins, uneven = starts.tolist(), set()
        low = (1 << _SHIFT) - 1
        known, find = self.merged, self._merge
        while heap:
            rank, code = heapq.heappop(heap)
            left, right = code >> _SHIFT, code & low
            places = index.pop(code)
            places.sort()
            for at in places:
                if sym[at] != left or sym[gone := after[at]] != right:
                    continue
                then = after[gone]
                sym[at], sym[gone] = rank, -2
                after[at], before[then] = then, at
                if (prior := before[at]) >= 0 and (other := sym[prior]) >= 0:
                    new = other << _SHIFT | rank
                    if (made := known.get(new)) is None:
                        made = find(new)
                    if made > rank:
                        if new in index:
                            index[new].append(prior)
                        else:
                            index[new] = [prior]
                            heapq.heappush(heap, (made, new))
                    elif made >= 0:  # its turn has passed: this word is done again by itself
                        uneven.add(bisect_right(begins, at) - 1)
                if (other := sym[then]) >= 0:
                    new = rank << _SHIFT | other
                    if (made := known.get(new)) is None:
                        made = find(new)
                    if made > rank:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, (made, new))
                    elif made >= 0:
                        uneven.add(bisect_right(begins, at) - 1)
        ids = np.asarray(sym, "i8")
        keep = ids >= 0
        cuts = np.concatenate([[0], np.cumsum(keep)])
        kept = ids[keep].astype("<u4").tobytes()
        lo, hi = (4 * cuts[starts]).tolist(), (4 * cuts[starts + lengths]).tolist()
        for k, i in enumerate(todo):
            out[i] = kept[lo[k] : hi[k]]
        for k in uneven:
            out[todo[k]] = np.asarray(self.alone(words[todo[k]]), "<u4").tobytes()
        return out  # type: ignore[return-value]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Encoder:
    """Whole texts to little-endian 32-bit ids, with a cache of pieces and of pattern matches."""

    def __init__(self, ranks_path: str, pattern: str, entries: int):
        self.replay = MergeReplay(load_ranks(ranks_path))
        self.pattern = regex.compile(pattern)
        self.entries = entries
        self.plain: dict[str, bytes] = {}
        self.match: dict[str, bytes] = {}
        # the newline that pieces() puts first must be a match and an id of its own
        self.cut = self.pattern.findall("\na") == ["\n", "a"] and b"\n" in self.replay.ranks

    def _learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.match]
        self.match.update(zip(new, self.replay.encode_words([m.encode("utf-8", "surrogatepass") for m in new])))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [pieces(t) if self.cut else None for t in texts]
        plain = self.plain
        if len(plain) > self.entries:
            plain = self.plain = {p: plain[p] for ps in cut for p in ps or () if p in plain}
        if len(self.match) > self.entries // 2:
            self.match = {}
        new: set[str] = set()
        for ps in cut:
            new.update(filterfalse(plain.__contains__, ps or ()))
        split = {p: self.pattern.findall(spelled(p)) for p in new}
        whole = [None if ps is not None else self.pattern.findall(t) for t, ps in zip(texts, cut)]
        self._learn({m for ms in split.values() for m in ms} | {m for ms in whole if ms for m in ms})
        match = self.match
        for p, ms in split.items():
            plain[p] = b"".join([match[m] for m in ms])
        return [b"".join([plain[p] for p in ps])[4:] if ps is not None else b"".join([match[m] for m in ms or ()]) for ps, ms in zip(cut, whole)]


_encoders: dict[tuple, _Encoder] = {}


def _encoder(*key) -> _Encoder:
    """One for a Python worker, which Spark uses for many tasks: what it keeps is a pure function of
    the vocabulary, so no result depends on it."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(*key)
    return _encoders[key]


def encode_documents(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, with_ids: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Rows ``(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256)``, one for each row of ``docs``.

    Every match of ``pattern`` in the whole text is encoded by itself, by the ranks in
    ``ranks_path``; no special tokens exist, so their spellings are ordinary text. The ids are then
    decoded and both sides hashed. Null and empty texts have no ids; very long texts are encoded
    whole and held one at a time; repeated rows and repeated or null doc_ids give a row each; an empty table gives an empty one; other columns are not read, so
    their names cannot clash. ``with_ids=False`` leaves the ids out. No shuffle.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields = [f for f in fields if with_ids or f[0] != "ids"]
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    if kind != "bigint":
        docs = docs.withColumn(id_col, F.col(id_col).cast("bigint"))

    def tasks(batches):
        encoder = _encoder(ranks_path, pattern, cache_entries)
        decode = encoder.replay.decode
        for batch in batches:
            for part in slices(batch, 1, RUN_BYTES):
                rows = {n: [] for n, _ in fields if n != "doc_id"}
                for raw in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(raw, "<u4")
                    rows["n_tokens"].append(len(ids))
                    rows["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decode(ids.tolist())).hexdigest())
                    if with_ids:
                        rows["ids"].append(ids.astype("i4"))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()) if n == "doc_id" else pa.array(rows[n], t) for n, t in fields], names=[n for n, _ in fields])

    schema = "doc_id bigint, " + ("ids array<int>, " if with_ids else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, schema)
