"""N-grams of texts, interned in an open-addressed table of numpy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: The primes of XXH64.
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes of a feature that are hashed and compared for many features at once; longer ones one at a time.
SHORT = 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: By number of bytes, the part of a little-endian 64-bit word that they are.
_LOW = np.asarray([(1 << 8 * n) - 1 for n in range(9)], "u8")


@dataclass
class Features:
    """Occurrences of features: where each begins in ``raw`` and how long it is, the number of its text,
    and the words of each text."""

    raw: bytes
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    words: np.ndarray


def features(raw: bytes, ends: np.ndarray, order: int = 1, skip: int = 0) -> Features:
    """All runs of one to ``order`` consecutive words of texts that lie end to end in ``raw``, up to
    ``ends``; the words of a run are joined by one space. Large letters A-Z are read as small. With
    ``skip``, the first words of the first text are there as a beginning only: runs that end in them, and
    they themselves, are not counted."""
    raw = raw.translate(_LOWER)
    signs = np.frombuffer(raw, "u1")
    inside = _WORD[signs]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    begins = begins[begins < len(signs)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(ends, start, "right")
    words = np.bincount(text, minlength=len(ends))
    if order > 1:
        # words end to end, with one space between, so that a run of words is a run of bytes
        length = end - start
        at = np.cumsum(length + 1) - length - 1
        even = np.full(int(length.sum()) + len(length), 32, "u1")
        even[np.repeat(at - np.cumsum(length) + length, length) + np.arange(int(length.sum()))] = signs[inside]
        raw, start, end = even.tobytes(), at, at + length
    starts, lengths, texts = [], [], []
    for n in range(order):
        kept = np.arange(len(start) - n) if len(start) > n else np.zeros(0, "i8")
        kept = kept[(text[kept] == text[kept + n]) & (kept + n >= skip)]
        starts.append(start[kept])
        lengths.append(end[kept + n] - start[kept])
        texts.append(text[kept])
    if skip:
        words[0] -= skip
    return Features(raw, np.concatenate(starts), np.concatenate(lengths), np.concatenate(texts), words)


def _lanes(raw: bytes) -> np.ndarray:
    """The little-endian 64-bit word at every byte."""
    padded = raw + bytes(8)
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64(raw: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of many parts of ``raw``; short ones of a length at a time."""
    out, lanes = np.empty(len(start), "u8"), _lanes(raw)
    order = np.argsort(np.minimum(length, SHORT).astype("u1"), kind="stable")
    bounds = np.searchsorted(np.minimum(length, SHORT)[order], np.arange(SHORT + 2))
    for n in range(SHORT):
        rows = order[bounds[n] : bounds[n + 1]]
        if not len(rows):
            continue
        at = start[rows]
        h = np.full(len(rows), P5 + np.uint64(n), "u8")
        done = 0
        while done + 8 <= n:
            h = _turned(h ^ _turned(lanes[at + done] * P2, 31) * P1, 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            h = _turned(h ^ (lanes[at + done] & _LOW[4]) * P1, 23) * P2 + P3
            done += 4
        for k in range(done, n):
            h = _turned(h ^ (lanes[at + k] & _LOW[1]) * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[rows] = h ^ h >> np.uint64(32)
    for row in order[bounds[SHORT] :].tolist():
        out[row] = xxhash.xxh64_intdigest(raw[start[row] : start[row] + length[row]])
    return out


class Table:
    """Distinct features in an open-addressed table: of a slot its key (the feature's hash), where its
    bytes are, its bucket and its count. A key is only taken for a feature's own if the bytes are equal
    as well, else the next slot is looked at."""

    def __init__(self, made: Features, buckets: int, keys: np.ndarray | None = None):
        self.made = made
        n = len(made.start)
        size = 1 << max(4, int(min(n, 1 << 14) * 2 - 1).bit_length())
        keys = xxh64(made.raw, made.start, made.length) if keys is None else keys
        self.slots = np.full(n, -1, "i8")
        self._lanes = _lanes(made.raw)
        self._empty(size)
        step = 1 << 16
        for lo in range(0, n, step):
            while (self.used + min(step, n - lo)) * 2 > len(self.owner) and len(self.owner) < 4 * n:
                self._grow(keys)
            self.slots[lo : lo + step] = self._intern(np.arange(lo, min(n, lo + step)), keys)
        self.count = np.bincount(self.slots, minlength=len(self.owner))
        self.bucket = np.zeros(len(self.owner), "i8")
        taken = np.flatnonzero(self.owner >= 0)
        who = self.owner[taken]
        raw = memoryview(made.raw)
        self.bucket[taken] = [zlib.crc32(raw[a : a + k]) % buckets for a, k in zip(made.start[who].tolist(), made.length[who].tolist())]

    def _empty(self, size: int) -> None:
        self.owner, self.key, self.used = np.full(size, -1, "i8"), np.zeros(size, "u8"), 0

    def _grow(self, keys: np.ndarray) -> None:
        """Twice the slots; what is interned keeps its owner and moves to its new slot."""
        before, owners = len(self.owner), self.owner[self.owner >= 0]
        moved = np.empty(before, "i8")
        old = np.flatnonzero(self.owner >= 0)
        self._empty(2 * before)
        moved[old] = self._intern(owners, keys)
        done = self.slots >= 0
        self.slots[done] = moved[self.slots[done]]

    def _intern(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slots of some occurrences; new features take free ones."""
        mask = len(self.owner) - 1
        out = np.full(len(rows), -1, "i8")
        left = np.arange(len(rows))
        at = (keys[rows] & np.uint64(mask)).astype("i8")
        while len(left):
            free = self.owner[at] < 0
            if free.any():
                # of those that want a free slot one gets it; the others compare themselves with it
                self.owner[at[free]] = rows[left[free]]
                got = np.unique(at[free])
                self.key[got] = keys[self.owner[got]]
                self.used += len(got)
            same = self.key[at] == keys[rows[left]]
            same[same] = self._equal(rows[left[same]], self.owner[at[same]])
            out[left[same]] = at[same]
            left, at = left[~same], at[~same] + 1 & mask
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether features have the same bytes."""
        start, length = self.made.start, self.made.length
        equal = length[a] == length[b]
        for done in range(0, SHORT, 8):
            live = np.flatnonzero(equal & (length[a] > done))
            if not len(live):
                break
            part = _LOW[np.minimum(length[a[live]] - done, 8)]
            equal[live] = (self._lanes[start[a[live]] + done] ^ self._lanes[start[b[live]] + done]) & part == 0
        raw = self.made.raw
        for k in np.flatnonzero(equal & (length[a] > SHORT) & (a != b)).tolist():
            x, y, n = start[a[k]], start[b[k]], length[a[k]]
            equal[k] = raw[x : x + n] == raw[y : y + n]
        return equal

    def by_bucket(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that are met, and how often."""
        taken = self.owner >= 0
        sums = np.bincount(self.bucket[taken], self.count[taken]).astype("i8")
        met = np.flatnonzero(sums)
        return met, sums[met]

    def sums(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text its occurrences, and the sum of the gains of their buckets."""
        gain = gains[self.bucket]
        total = np.zeros(texts, "i8")
        np.add.at(total, self.made.text, gain[self.slots])
        return np.bincount(self.made.text, minlength=texts), total


def parts(texts: list[bytes], order: int = 1, most: int = 1 << 20) -> Iterator[tuple[list[int], Features]]:
    """The features of texts in parts of about ``most`` bytes, each with the numbers of its texts. A longer
    text comes in several parts, cut between words, each with the words before it that its first runs
    need; a word that is longer itself stays whole."""
    ids: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > most:
            for piece, skip in _cut(text, order, most):
                yield [i], features(piece, np.asarray([len(piece)]), order, skip)
            continue
        if size + len(text) > most:
            yield ids, features(b"".join(held), np.cumsum([len(t) for t in held]), order)
            ids, held, size = [], [], 0
        ids.append(i)
        held.append(text)
        size += len(text)
    if ids:
        yield ids, features(b"".join(held), np.cumsum([len(t) for t in held]), order)


def _cut(text: bytes, order: int, most: int) -> Iterator[tuple[bytes, int]]:
    lo, tail = 0, b""
    while lo < len(text):
        hi = min(len(text), lo + most)
        while hi < len(text) and _is_word(text[hi]) and _is_word(text[hi - 1]):
            hi += 1
        skip = len(tail.split())
        piece = tail + text[lo:hi]
        yield piece, skip
        if order > 1:
            made = features(piece, np.asarray([len(piece)]))
            # words as they are in the part, the last ones that a run can begin with
            tail = b"".join(made.raw[a : a + n] + b" " for a, n in zip(made.start[-(order - 1) :].tolist(), made.length[-(order - 1) :].tolist()))
        lo = hi


def _is_word(sign: int) -> bool:
    return bool(_WORD[_LOWER[sign]])
