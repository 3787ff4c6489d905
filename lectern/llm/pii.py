"""Personal data: base patterns, and a linear-chain conditional random field for what they miss.

The base patterns are exact and stay as they are. The field reads a line as a sequence of words,
numbers and signs, each with features of its shape and its neighbours' shapes; it is trained from a
small labelled table by gradient ascent on the conditional likelihood and decoded by Viterbi for
many lines at once in numpy. A span of the kinds known here has a digit or an @, plain or written out
(``(at)``, ``[at]``, `` at `` with `` dot `` behind it), so lines without any of them are not decoded.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone")
#: Bytes of text that are held as Python strings at a time.
SLICE_BYTES = 2 << 20
Span = tuple[str, int, int]

# ---- base patterns -----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[Span]:
    """Goes from @ to @: what the pattern matches left of one starts where its run of characters
    does, or where the match before ended. So no run is read more than twice."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    low = sum(map(int, digits[-1::-2]))
    return (low + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the base patterns by start, then kind; and matches that failed their test."""
    good, bad = _emails(text) if "@" in text else [], []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            (good if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts) else bad).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            (good if 14 <= len(digits) <= 19 and luhn(digits) else bad).append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            (good if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15 else bad).append(("phone", *m.span()))
    return sorted(good, key=_order), bad


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the labelled table ------------------------------------------------------------------------

#: Labelled lines: a split (train or held_out) and a text in which {kind:text} is a span and all else is
#: not personal data. The driver reads them; tasks get the trained field.
LABELS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_labels.tsv")

_LABEL = re.compile(r"\{(" + "|".join(KINDS) + r"):([^}]*)\}")


def labelled_table(split: str = "train", path: str = LABELS) -> list[tuple[str, list[Span]]]:
    """The lines of a split as (text, spans)."""
    out = []
    with open(path, encoding="utf-8") as rows:
        for row in rows.read().splitlines()[1:]:
            kind, line = row.split("\t")
            if kind != split:
                continue
            text, spans, last = "", [], 0
            for m in _LABEL.finditer(line):
                text += line[last : m.start()]
                spans.append((m[1], len(text), len(text) + len(m[2])))
                text += m[2]
                last = m.end()
            out.append((text + line[last:], spans))
    return out


# ---- the field ---------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\w")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def shape(token: str) -> str:
    """``9`` and the number of digits, ``x``, ``X`` or ``Xx`` for words, a sign as it is; short words
    of letters a-z also matter as themselves."""
    if token.isdigit():
        return f"9{min(len(token), 9)}"
    if token.isalpha():
        return "x" if token.islower() else "Xx" if token[1:].islower() else "X"
    return token


def line_features(text: str, places: list[tuple[int, int]] | None = None) -> tuple[list[list[str]], list[tuple[int, int]]]:
    """The features of the tokens of a line, or of those at ``places`` as if there were no others."""
    places = [m.span() for m in _TOKEN.finditer(text)] if places is None else places
    tokens = [text[a:b] for a, b in places]
    shapes = [shape(t) for t in tokens]
    gap = ["_" if i and places[i][0] > places[i - 1][1] else "" for i in range(len(tokens))]
    s = ["^^", "^", *shapes, "$", "$$"]
    g = ["", "", *gap, "", ""]
    out = []
    for i, token in enumerate(tokens, 2):
        f = ["bias", f"0{g[i]}{s[i]}", f"-1{s[i - 1]}{g[i]}", f"+1{g[i + 1]}{s[i + 1]}", f"-1+0{s[i - 1]}{g[i]}{s[i]}", f"+0+1{s[i]}{g[i + 1]}{s[i + 1]}", f"-2-1{s[i - 2]}{g[i - 1]}{s[i - 1]}", f"+1+2{s[i + 1]}{g[i + 2]}{s[i + 2]}", f"-1+1{s[i - 1]}{g[i]}{g[i + 1]}{s[i + 1]}"]
        lower = tokens[i - 2].lower()
        out.append([*f, f"w{lower}"] if len(lower) <= 5 and lower.isalpha() else f)
    return out, places


Scores = tuple[np.ndarray, np.ndarray]


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def scores(self, lines: list[list[list[str]]]) -> Scores:
        """(line, place, tag) sums of weights, padded, and the lengths."""
        n = np.asarray([len(x) for x in lines], "i8")
        out = np.zeros((len(lines), int(n.max(initial=0)), len(TAGS)))
        if out.size:
            get, none = self.index.get, len(self.emit)
            ids = np.asarray([get(f, none) for line in lines for fs in line for f in fs])
            each = np.asarray([len(fs) for line in lines for fs in line])
            weights = np.vstack([self.emit, np.zeros(len(TAGS))])
            out[np.arange(out.shape[1]) < n[:, None]] = np.add.reduceat(weights[ids], np.cumsum(each) - each)
        return out, n

    def viterbi(self, made: Scores) -> list[np.ndarray]:
        """The best tags of each line, all lines a step at a time."""
        e, n = made
        if not e.size:
            return [np.zeros(0, "i8") for _ in n]
        best, back = self.start + e[:, 0], np.zeros(e.shape, "i1")
        for t in range(1, e.shape[1]):
            way = best[:, :, None] + self.step
            back[:, t] = way.argmax(1)
            new = way.max(1) + e[:, t]
            best = np.where((t < n)[:, None], new, best)
        tags = np.zeros(e.shape[:2], "i8")
        now = best.argmax(1)
        for t in reversed(range(e.shape[1])):
            tags[:, t] = now
            if t:
                now = np.where(t < n, back[np.arange(len(now)), t, now], now)
        return [row[:k] for row, k in zip(tags, n)]

    def chances(self, made: Scores, tags: list[np.ndarray]) -> list[np.ndarray]:
        """The posterior chance of each of the given tags, by forward and backward sums."""
        e, n = made
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = self.start + e[:, 0]
        for t in range(1, e.shape[1]):
            ahead[:, t] = np.where((t < n)[:, None], _total(ahead[:, t - 1, :, None] + self.step, 1) + e[:, t], ahead[:, t - 1])
        for t in reversed(range(e.shape[1] - 1)):
            behind[:, t] = np.where((t + 1 < n)[:, None], _total(self.step + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        z = _total(ahead[:, -1], 1)
        return [np.exp((a + b)[np.arange(k), x] - c) for a, b, x, k, c in zip(ahead, behind, tags, n.tolist(), z)]


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gold(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    out = []
    for a, b in places:
        tag = "O"
        for kind, x, y in spans:
            if x <= a and b <= y:
                tag = f"{'B' if a == x else 'I'}-{kind}"
        out.append(TAGS.index(tag))
    return out


def train(table: list[tuple[str, list[Span]]], rounds: int = 80, rate: float = 0.1, shrink: float = 0.02) -> Field:
    """Adam on the penalised conditional log-likelihood, all lines a step at a time. An inside tag
    may only follow a tag of its kind, in training and after."""
    made = [line_features(t) for t, _ in table]
    lines = [f for f, _ in made]
    index: dict[str, int] = {}
    for line in lines:
        for fs in line:
            for f in fs:
                index.setdefault(f, len(index))
    k, count = len(TAGS), len(lines)
    n = np.asarray([len(x) for x in lines])
    width = int(n.max())
    ids = np.full((count, width, 10), len(index))
    gold = np.zeros((count, width), "i8")
    for i, (line, (_, spans)) in enumerate(zip(lines, table)):
        for t, fs in enumerate(line):
            ids[i, t, : len(fs)] = [index[f] for f in fs]
        gold[i, : n[i]] = _gold(made[i][1], spans)
    inside = np.arange(width) < n[:, None]
    barred = np.asarray([[-1e4 if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in TAGS] for a in TAGS])
    first = np.asarray([-1e4 if b[0] == "I" else 0.0 for b in TAGS])
    truth = np.eye(k)[gold] * inside[..., None]
    pairs = np.einsum("ita,itb->ab", truth[:, :-1], truth[:, 1:])
    theta = [np.zeros((len(index) + 1, k)), np.zeros((k, k))]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]

    # where each feature stands, for sums by feature
    flat = ids.ravel()
    there = np.flatnonzero(flat < len(index))
    there = there[np.argsort(flat[there], kind="stable")]
    seen, starts = np.unique(flat[there], return_index=True)
    for r in range(1, rounds + 1):
        e, step = theta[0][ids].sum(2), theta[1] + barred
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = first + e[:, 0]
        for t in range(1, width):
            ahead[:, t] = np.where(inside[:, t, None], _total(ahead[:, t - 1, :, None] + step, 1) + e[:, t], ahead[:, t - 1])
        for t in reversed(range(width - 1)):
            behind[:, t] = np.where(inside[:, t + 1, None], _total(step + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        z = _total(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - z[:, None, None]) * inside[..., None]
        both = ahead[:, :-1, :, None] + step + (e + behind)[:, 1:, None, :] - z[:, None, None, None]
        two = (np.exp(np.minimum(both, 0)) * inside[:, 1:, None, None]).sum((0, 1))
        g = [np.zeros_like(theta[0]), pairs - two - shrink * theta[1]]
        g[0][seen] = np.add.reduceat((truth - chance).reshape(-1, k)[there // 10], starts)
        g[0] -= shrink * theta[0]
        for i in (0, 1):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            theta[i] = theta[i] + rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.999**r)) + 1e-8)
    return Field(index, theta[0][:-1], theta[1] + barred, first)


#: A span of the field counts where the chance of every one of its tags, given the line, is so high.
SURE = 0.9


def _holds(kind: str, text: str) -> bool:
    """The test of a kind, as far as it is one of numbers and lengths."""
    numbers = re.findall(r"[0-9]+", text)
    digits = sum(map(len, numbers))
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 14 <= digits <= 19 and luhn("".join(numbers))
    return len(text) <= 254 if kind == "email" else 9 <= digits <= 15


#: Tokens of a line that are decoded as one sequence; longer lines are cut, with so many tokens of
#: both parts in common. Features look at two tokens before and after.
LINE, OVERLAP, NEAR = 512, 64, 2
#: Tokens whose features are held at a time.
HELD = 40_000
_MARK = re.compile(r"[0-9@]|\([Aa][Tt]\)|\[[Aa][Tt]\]")


def _marked(text: str) -> bool:
    """Whether a line can hold a span of the field (a longer text: may have such a line)."""
    if _MARK.search(text):
        return True
    low = text.lower()
    at = low.find(" at ")
    return at >= 0 and low.find(" dot ", at + 4) >= 0


def line_parts(line: str) -> Iterator[tuple[list[list[str]], list[tuple[int, int]]]]:
    """Features and places of a line's tokens in parts of up to ``LINE``, made one at a time."""
    found = (m.span() for m in _TOKEN.finditer(line))
    held: list[tuple[int, int]] = []  # from NEAR tokens before the part
    before = 0
    for place in found:
        held.append(place)
        if len(held) == before + LINE + NEAR:
            fs, _ = line_features(line, held)
            yield fs[before : before + LINE], held[before : before + LINE]
            held = held[before + LINE - OVERLAP - NEAR :]
            before = NEAR
    if len(held) > before + OVERLAP or not before:
        fs, _ = line_features(line, held)
        for lo in range(before, max(before + 1, len(held) - OVERLAP), LINE - OVERLAP):
            yield fs[lo : lo + LINE], held[lo : lo + LINE]


def _lines(texts: list[str]) -> Iterator[tuple[int, int, list, list]]:
    """What is decoded: the number of a text, where its line begins, features and places of a part."""
    for i, text in enumerate(texts):
        if _marked(text):
            at = 0
            for line in text.split("\n"):
                if _marked(line):
                    for fs, places in line_parts(line):
                        yield i, at, fs, places
                at += len(line) + 1


def field_spans(texts: list[str], model: Field, batch: int = 512, sure: float = SURE) -> list[list[Span]]:
    """Spans that the field finds in each text and is sure of, by start."""
    found: list[set[Span]] = [set() for _ in texts]

    def decode(todo: list[tuple[int, int, list, list]]) -> None:
        todo.sort(key=lambda x: len(x[2]))
        for lo in range(0, len(todo), batch):
            part = todo[lo : lo + batch]
            sums, n = model.scores([x[2] for x in part])
            best = model.viterbi((sums, n))
            told = [k for k, tags in enumerate(best) if tags.any()]
            for k, chance in zip(told, model.chances((sums[told], n[told]), [best[k] for k in told]) if told else ()):
                (i, at, _, places), tags = part[k], best[k]
                for t in np.flatnonzero(tags).tolist():
                    name = TAGS[tags[t]]
                    if name[0] == "B":
                        last = t
                        while last + 1 < len(tags) and TAGS[tags[last + 1]] == f"I-{name[2:]}":
                            last += 1
                        a, b = at + places[t][0], at + places[last][1]
                        if chance[t : last + 1].min() >= sure and _holds(name[2:], texts[i][a:b]):
                            found[i].add((name[2:], a, b))

    todo, held = [], 0
    for x in _lines(texts):
        todo.append(x)
        held += len(x[2])
        if held >= HELD:
            decode(todo)
            todo, held = [], 0
    decode(todo)
    return [sorted(x, key=_order) for x in found]


def scores(model: Field, table: list[tuple[str, list[Span]]]) -> tuple[float, float]:
    """Precision and recall of whole spans on labelled lines."""
    found = [set(x) for x in field_spans([t for t, _ in table], model)]
    right = sum(len(f & set(s)) for f, (_, s) in zip(found, table))
    return right / max(sum(map(len, found)), 1), right / max(sum(len(s) for _, s in table), 1)


def merged(good: list[Span], bad: list[Span], more: list[Span]) -> list[Span]:
    """Base spans and those of ``more`` that touch no base span and none before them, and are not matches
    that failed the test of their kind (``bad``). All lists are by start."""
    starts, ends = [a for _, a, _ in good], list(accumulate((b for *_, b in good), max))
    failed, added, last = set(bad), [], 0
    for span in more:
        _, a, b = span
        before = bisect_left(starts, b)
        if span not in failed and a >= last and not (before and ends[before - 1] > a):
            added.append(span)
            last = b
    return sorted(good + added, key=_order)


def find_spans(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, field_spans(texts, model)):
        good, bad = base_spans(text)
        out.append((good, merged(good, bad, more)))
    return out


@functools.cache
def trained() -> Field:
    """The field of the labelled table, trained once in a session."""
    return train(labelled_table())


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the first."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """Rows ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one for each row.

    Counts and hash are of the base spans, ``spans`` lists all. Null and empty texts have none; the
    hash is then of the empty string. Very long texts are scanned whole, in linear time, and held one
    at a time; the field reads a very long line in overlapping parts, so many tokens at a time. Of spans that start together the
    kinds come in the order of ``KINDS``. Repeated rows and repeated or null doc_ids are rows of their
    own; an empty table gives none; other columns are not read. No shuffle.
    """
    model = model or trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def tasks(batches):
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                found = find_spans([t or "" for t in part.column(1).to_pylist()], model)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([joined(every) for _, every in found], pa.string())], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", model: Field | None = None) -> DataFrame:
    """``docs`` with the spans in its text replaced by their kinds; all other columns as they were.

    Null and empty texts stay; very long ones are replaced whole. Of spans that overlap, the first by
    start, then kind, is replaced. Repeated rows stay rows of their own; an empty table stays empty;
    the names of other columns cannot clash."""
    model = model or trained()

    @F.pandas_udf("string")
    def clean(text):
        import pandas as pd

        out: list[str | None] = []
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])
        for part in slices(batch, 0, SLICE_BYTES):
            texts = part.column(0).to_pylist()
            out += [None if t is None else redacted(t, every) for t, (_, every) in zip(texts, find_spans([t or "" for t in texts], model))]
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
