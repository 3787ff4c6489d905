"""Best-fit packing of token pieces by the linear grouping scheme.

Tokens are counted where the texts are; only a histogram of piece lengths (at most as many rows as a
sequence has tokens) reaches the driver, and only a plan of as bounded a size goes back. The plan
rounds large lengths up to the largest of their group, groups having equal numbers of pieces, solves
the few-size packing by column generation and puts actual lengths in all places of a configuration:
each place takes the largest piece left that its size, and what the places before it lost by
rounding, admit. The small pieces, and large ones that are alone in their configuration, go where
they fit best. The plan speaks of runs of pieces of equal length, so its size does not depend on how
many there are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from .pieces import blank, pieces, spelled
from .shared import one_thread, slices, stored

#: Parts of a sequence above which a length is large, each with its number of groups, in the order in
#: which they are tried.
THRESHOLDS = ((1 / 3, 96), (1 / 4, 80), (1 / 6, 64), (1 / 10, 48))
#: Parts of a solution that are carried out, in the order in which they are tried: all of it, or less where
#: what its configurations lose by rounding costs sequences.
PARTS = (1, 4 / 5, 3 / 5)
#: Room, as a part of a sequence, that small pieces can be counted on to fill.
USABLE = 5 / 32
#: Pieces that a Python worker keeps.
CACHE_ENTRIES = 800_000
SIGNS = ",.;:!?"
#: Bytes of text that are held as Python strings at a time.
SLICE_BYTES = 2 << 20


# ---- tokens -----------------------------------------------------------------------------------


class _Counter:
    """Whole texts to little-endian 32-bit ids by the tokenizers library, with a cache of pieces."""

    def __init__(self, path: str, entries: int):
        one_thread()
        self.tokenizer = Tokenizer.from_file(path)
        #: Spellings that the library takes for ids of their own: texts with one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.entries = entries
        self.plain: dict[str, bytes] = {}
        # bytes of text that each id stands for: a character of its name is a byte
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), "i8")
        for name, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(name)
        probe = self._encode(["\n", "\na", "a", " b", "a b", ","])
        self.cut = len(probe[0]) == 4 and probe[1] == probe[0] + probe[2] and probe[4] == probe[2] + probe[3]
        self.sign = dict(zip(SIGNS, self._encode(list(SIGNS))))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[str]) -> None:
        """New pieces are encoded end to end, which cuts them where the text would, and their ids told
        apart by the bytes they stand for."""
        for lo in range(0, len(new), 2000):
            part = [p if p[0].isspace() else " " + p for p in new[lo : lo + 2000]]  # ``spelled``, for pieces that are not blank
            raw = self._encode(["".join(part)])[0]
            ends = np.cumsum(np.fromiter((len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass")) for s in part), "i8", len(part)))
            at = np.searchsorted(np.cumsum(self.bytes[np.frombuffer(raw, "<u4")]), ends, side="right")
            bounds = [0, *(4 * at).tolist()]
            self.plain.update((p, raw[a:b]) for p, a, b in zip(new[lo : lo + 2000], bounds, bounds[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [pieces(t) if self.cut and not any(a in t for a in self.added) else None for t in texts]
        plain = self.plain
        if len(plain) > self.entries:
            # what is met now stays, and the shorter half: short pieces come again, most long ones do not
            lengths = np.fromiter(map(len, plain), "i8", len(plain))
            longest = int(np.sort(lengths)[self.entries // 2])
            kept = {p: raw for p, raw in plain.items() if len(p) < longest}
            kept.update((p, plain[p]) for ps in cut for p in ps or () if p in plain)
            plain = self.plain = kept
        fresh: set[str] = set()
        for ps in cut:
            fresh.update(filterfalse(plain.__contains__, ps or ()))
        # white space would join with what stands beside it
        alone = list(filter(blank, fresh))
        plain.update(zip(alone, self._encode(list(map(spelled, alone)))))
        fresh.difference_update(alone)
        # letters and one sign are two matches of the pattern: the letters are looked up alone
        signed = [p for p in fresh if p[-1] in self.sign and p[:-1].isalpha()]
        self._learn(list({p[:-1] for p in signed if p[:-1] not in plain}.union(fresh.difference(signed))))
        plain.update((p, plain[p[:-1]] + self.sign[p[-1]]) for p in signed)
        rest = iter(self._encode([t for t, ps in zip(texts, cut) if ps is None]))
        return [next(rest) if ps is None else b"".join(map(plain.__getitem__, ps))[4:] for ps in cut]


_counters: dict[tuple, _Counter] = {}


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, part)`` for every piece of every text: its ids
    and ``end_id``, cut into pieces of ``capacity`` of which the first may be shorter. No shuffle."""

    def tasks(batches):
        key = (tokenizer_path, cache_entries)
        if key not in _counters:
            _counters[key] = _Counter(*key)
        encode, end = _counters[key].encode, np.asarray([end_id], "<u4").tobytes()
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                rows: list[tuple] = []
                for key, raw in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    n = len(raw) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    rows += [(key, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))
            # what Arrow keeps for later batches is memory that the executor lacks
            pa.default_memory_pool().release_unused()

    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return found.withColumn("part", F.spark_partition_id())


# ---- the plan, on lengths and their counts ------------------------------------------------------


def _groups(lengths: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """(length, count) in falling order, cut into ``k`` groups of equal cardinality (the last may be
    smaller); groups that round up to the same length are one."""
    size = -(-sum(n for _, n in lengths) // k)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    merged: list[list[tuple[int, int]]] = []
    for g in out:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    return merged


class _Bins:
    """Sequences by what they hold: classes (count, lengths), found by the room left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.rooms: list[int] = []

    def add(self, count: int, held: tuple[int, ...]) -> None:
        if count:
            room = self.capacity - sum(held)
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append((count, held))

    def count(self) -> int:
        return sum(n for classes in self.by_room.values() for n, _ in classes)

    def best_fit(self, length: int, n: int) -> None:
        """``n`` pieces of one length, each where it leaves the least room; new sequences if none
        has room. Best fit goes on with the sequence it has just used, so each is filled at once."""
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                self.add(n // each, (length,) * each)
                self.add(1 if n % each else 0, (length,) * (n % each))
                return
            room = self.rooms[at]
            count, held = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(at)
            each = room // length
            full = min(count, n // each)
            n -= full * each
            self.add(full, held + (length,) * each)
            count -= full
            if count and n:
                self.add(1, held + (length,) * n)
                count, n = count - 1, 0
            self.add(count, held)


def _best_columns(worth: np.ndarray, below: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... places: the most that sizes of a sum of exactly f can be worth, for every f, and
    the size put last. ``below[i, f]`` is f less size i, or the cell behind the last where that is
    negative."""
    most = np.full(below.shape[1] + 1, -np.inf)
    most[0] = 0
    for _ in range(places):
        value = most[below] + worth[:, None]
        last = value.argmax(0)
        most = np.append(value[last, np.arange(below.shape[1])], -np.inf)
        yield most[:-1], last


def _configurations(sizes: list[int], demand: list[int], sequences: int, capacity: int, usable: int) -> tuple[list[tuple[np.ndarray, float]], bool]:
    """Configurations of the rounded sizes with (fractional) numbers of sequences, and whether more than
    ``sequences`` are needed: the linear relaxation by column generation.

    ``sequences`` is what all tokens would fill. More of them are used only where they must; within
    them, room is lost where a configuration leaves less than small pieces can be counted on to fill."""
    s, m = np.asarray(sizes), len(sizes)
    room = np.arange(capacity + 1)
    lost = np.where(room < usable, room / max(usable, 1), 0.0)[::-1]  # by the sum of sizes
    # a little uneven, so that no step leaves all as it was
    d = np.asarray(demand, float) * (1 + 1e-7 * np.random.default_rng(0).random(m))
    beyond = 10.0  # what a sequence beyond ``sequences`` costs
    basis = np.eye(m + 1)
    basis[m, :m] = 1
    over = d.sum() > sequences
    basis[m, m] = -1 if over else 1
    cost = np.append(lost[s], beyond if over else 0.0)
    x = np.append(d, abs(d.sum() - sequences))
    slack = np.append(np.zeros(m), 1.0)
    below = room[None, :] - s[:, None]
    below = np.where(below < 0, capacity + 1, below)
    inverse, rounds, best, since = np.linalg.inv(basis), 0, np.inf, 0
    while since < 200:
        worth = cost @ inverse
        gain, column, price = worth[m], slack, 0.0
        lasts = []
        for n, (value, last) in enumerate(_best_columns(worth[:m], below, capacity // int(s.min())), 1):
            lasts.append(last)
            f = int((value - lost).argmax())
            if value[f] - lost[f] + worth[m] > gain:
                gain, price, column = value[f] - lost[f] + worth[m], lost[f], slack.copy()
                for last in reversed(lasts):
                    column[last[f]] += 1
                    f -= s[last[f]]
        if gain < 1e-6:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out], basis[:, out], cost[out] = ratio[out], column, price
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        rounds += 1
        if rounds % 64 == 0:
            inverse = np.linalg.inv(basis)
        now = float(cost @ x)
        best, since = (now, 0) if now < best - 1e-9 else (best, since + 1)
    used = [(basis[:m, j].astype("i8"), float(x[j])) for j in np.argsort(-x, kind="stable") if basis[:m, j].any()]
    return used, bool(((cost >= beyond) & (x > 0.5)).any())


def _carry_out(bins: _Bins, rest: dict[int, int], used: list[tuple[list[int], int]], capacity: int, usable: int) -> None:
    """Fills configurations (sizes in falling order, number of sequences) with actual lengths from
    ``rest``. Every place is filled: the pieces left always hold one that fits it, as sizes were
    rounded up. The last place may also use room that nothing else can."""
    lengths = sorted(rest)

    def take(limit: int, n: int) -> Iterator[tuple[int, int]]:
        while n:
            length = lengths[bisect_right(lengths, limit) - 1]
            got = min(n, rest[length])
            n, rest[length] = n - got, rest[length] - got
            if not rest[length]:
                del rest[length], lengths[bisect_left(lengths, length)]
            yield length, got

    for sizes, n in sorted(used, reverse=True):
        held: list[tuple[tuple[int, ...], int]] = [((), n)]
        for k in range(1, len(sizes) + 1):
            end = sum(sizes[:k]) if k < len(sizes) or capacity - sum(sizes) >= usable else capacity
            held = [(have + (length,), got) for have, count in held for length, got in take(end - sum(have), count)]
        for have, count in held:
            bins.add(count, have)


def _scheme(histogram: dict[int, int], capacity: int, large: float, groups: int, part: float) -> tuple[_Bins, int, bool]:
    """The sequences of one threshold, how many of them configurations set, and whether ``part`` had a say.
    That part of each number of the solution, rounded down, is carried out. Where configurations need more
    sequences than the tokens fill, it is half, and what is left is grouped anew, with finer groups as it is
    less, and so on until nothing more is carried out. The small pieces, and large ones that are left, go by best fit into the rooms."""
    bins, rest = _Bins(capacity), dict(histogram)
    sequences = -(-sum(a * n for a, n in histogram.items() if a < capacity) // capacity)
    usable, short, last = int(USABLE * capacity), False, False
    while not last:
        big = sorted(((a, n) for a, n in rest.items() if large * capacity < a < capacity), reverse=True)
        if not big or capacity // big[-1][0] < 2:
            break
        grouped = _groups(big, groups)
        sizes, left = [g[0][0] for g in grouped], np.asarray([sum(n for _, n in g) for g in grouped])
        found, short = _configurations(sizes, left.tolist(), max(sequences - bins.count(), 0), capacity, usable)
        used = []
        for use, x in found:
            n = min(int(x * (0.5 if short else part) + 1e-6), *(left[use > 0] // use[use > 0]).tolist()) if use.sum() > 1 else 0
            if n:
                left = left - n * use
                used.append(([size for size, k in zip(sizes, use.tolist()) for _ in range(k)], n))
        stock = {a: rest.pop(a) for a, _ in big}
        _carry_out(bins, stock, used, capacity, capacity + 1 if short else usable)
        rest |= stock
        last = not short or not used
    planned = bins.count()
    for length in sorted(rest, reverse=True):
        bins.best_fit(length, rest[length])
    return bins, planned, not short


def chosen(histogram: dict[int, int], capacity: int, thresholds: tuple[tuple[float, int], ...] = THRESHOLDS) -> tuple[_Bins, int]:
    """The sequences of the plan, and how many of them configurations set.

    What is large, and how much of a solution is carried out, is settled by trial, in the order of
    ``thresholds`` and ``PARTS``: until a plan needs no more sequences than best fit alone would and at
    most a thousandth more than the tokens fill; else the plan of the fewest sequences. Best fit alone is
    the last of the plans, with one half as its threshold, above which no configuration has two places.
    """
    plain, *_ = _scheme(histogram, capacity, 1 / 2, 1, 1)
    fills = -(-sum(a * n for a, n in histogram.items()) // capacity)
    enough = min(plain.count(), fills + fills // 1000)
    best: tuple[_Bins, int] | None = None
    for large, groups in thresholds:
        for part in PARTS:
            bins, planned, partly = _scheme(histogram, capacity, large, groups, part)
            if best is None or bins.count() < best[0].count():
                best = bins, planned
            if best[0].count() <= enough:
                return best
            if not partly:
                break
    return best if best is not None and best[0].count() <= plain.count() else (plain, 0)


def plan(histogram: dict[int, int], capacity: int, thresholds: tuple[tuple[float, int], ...] = THRESHOLDS) -> dict[str, np.ndarray]:
    """Runs: pieces of ``length`` with ranks ``rank``..``rank+count-1`` go to sequences
    ``sequence``..``sequence+count-1``, at ``offset`` in each. Never more sequences than best fit alone."""
    histogram = {a: n for a, n in histogram.items() if n}
    if histogram and (max(histogram) > capacity or min(histogram) < 1):
        raise ValueError("a piece is longer than a sequence, or empty")
    bins, _ = chosen(histogram, capacity, thresholds)
    runs, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in bins.rooms:
        for count, held in bins.by_room[room]:
            offset = 0
            for length in held:
                runs.append((length, ranks[length], count, sequence, offset))
                ranks[length] += count
                offset += length
            sequence += count
    table = np.asarray(sorted(runs), "i8").reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "sequence", "offset"), table.T))


# ---- the packing -------------------------------------------------------------------------------


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, thresholds: tuple[tuple[float, int], ...] = THRESHOLDS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one for each piece.

    Every row of ``docs`` gives at least one piece: a null or empty text has the end id alone. A text
    of up to ``capacity`` ids is one piece; a longer one, however long, is cut, nothing is dropped. The
    spelling of an added token is that token, as the library has it by default. Repeated rows and
    repeated or null doc_ids are packed as often as they stand there; an empty table gives no rows;
    other columns are not read. Pieces of one length are numbered through without gathering them: by
    the part they were made in, then within it.
    """
    made = stored(token_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id, cache_entries), "pieces")
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(histogram, capacity, thresholds)
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = made.withColumn("rank", F.row_number().over(W.partitionBy("part", "length").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    key = runs["length"] << 40 | runs["rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(runs["sequence"][at] + rank - runs["rank"][at]), pa.array(runs["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
