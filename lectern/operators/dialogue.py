"""Dialogue-aware chunks as a fold over sentences, Column to Column.

A chunk grows by sentences until the next one does not fit. What happens then is read from features of
the place: whether the words around it may be parted (``boundary.is_safe_break``), where else the chunk
would better be cut (``boundary.best_split``), and how full it is. Each answer is a pair: what is
finished, and what goes on growing; the first answer that applies holds. Chunks that are too long all the
same are cut at signs, else between words, and short ones join a neighbour afterwards.

White space is made single spaces once, for a whole text. All steps rely on it: sentences and chunks have
none at their ends and no two spaces within.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import boundary as B, text as T
from .chunkers import in_blocks

# Where an oversized chunk may be cut, best first.
CUTS = (
    r"[,;] ",
    r" (?:and|but|or|however|meanwhile|then|while|when|as|because) ",
    r" (?:after|before|during|since|until|while) ",
    r" -- ",
    r" \( ?",
)
#: Chunks under so many characters look for a neighbour: the one after, or for the last the one before.
SHORT, SHORT_LAST = 40, 25
#: A chunk as full as this ends where nothing better is found.
FULL = 0.8

STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _beside(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def lines(parts: Column, limit: int) -> Column:
    """Parts, without spaces around and not empty, laid into lines of up to ``limit``; a longer part is a line."""
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")

    def lay(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce(F.length(last) + 1 + F.length(part) <= limit, F.lit(False))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_beside(last, part)))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(clean, _none(), lay)


def cut_down(chunk: Column, limit: int) -> Column:
    """A chunk in lines that fit: cut at the first kind of place that it has, whose signs are lost, else
    between words."""
    parts = F.when(F.lit(False), _none())
    for cut in CUTS:
        parts = parts.when(chunk.rlike(cut), F.split(chunk, cut))
    laid = T.let(lines(parts.otherwise(T.words(chunk, even=True)), limit), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(""))))
    return F.when(F.length(chunk) <= limit, F.array(chunk)).otherwise(laid)


def _pair(done: Column, now: Column) -> Column:
    return F.struct(done.alias("done"), now.alias("now"))


def parted(now: Column, sentence: Column, limit: int) -> Column:
    """What is finished and what goes on where ``sentence`` does not fit behind ``now``."""
    here = _pair(F.array(now), sentence)

    def inner(at: Column) -> Column:
        w = T.words(now, even=True)
        first, rest = F.slice(w, F.lit(1), at), F.slice(w, at + 1, F.size(w))
        return _pair(F.array(F.array_join(first, " ")), _beside(F.array_join(rest, " "), sentence))

    found = T.let(B.best_split(now, sentence, limit, even=True), lambda at: F.when(at.isNotNull(), inner(at)))
    enough = F.when(F.length(now) > limit * FULL, here).otherwise(_pair(_none(), _beside(now, sentence)))
    return F.when(now == "", _pair(_none(), sentence)).when(B.is_safe_break(now, sentence, even=True), here).otherwise(F.coalesce(found, enough))


def grown(sentences: Column, limit: int) -> Column:
    """Chunks as they grow, before short ones are joined."""

    def step(state: Column, sentence: Column) -> Column:
        def settled(p: Column) -> Column:
            return T.let(cut_down(p["now"], limit), lambda parts: _pair(F.concat(state["done"], p["done"], F.slice(parts, F.lit(1), F.size(parts) - 1)), F.element_at(parts, -1)))

        together = F.when(state["now"] == "", sentence).otherwise(_beside(state["now"], sentence))
        return F.when(F.length(together) <= limit, _pair(state["done"], together)).otherwise(T.let(parted(state["now"], sentence, limit), settled))

    return in_blocks(sentences, _pair(_none(), F.lit("")), step, lambda s: F.when(s["now"] == "", _none()).otherwise(F.array(s["now"])))


def merged(chunks: Column, limit: int) -> Column:
    """A short chunk joins the next one, which then joins no other; the last joins the one before. While
    folding, ``held`` is a short chunk that waits for the next, ``last`` what came before it."""
    nothing = F.lit(None).cast("string")

    def state_of(done: Column, last: Column, held: Column) -> Column:
        return F.struct(done.alias("done"), last.alias("last"), held.alias("held"))

    def one_more(state: Column) -> Column:
        return F.concat(state["done"], F.filter(F.array(state["last"]), lambda x: x.isNotNull()))

    def joins(a: Column, b: Column) -> Column:
        return F.when(F.length(a) + 1 + F.length(b) <= limit, B.is_safe_merge(a, b, even=True)).otherwise(False)

    def step(state: Column, chunk: Column) -> Column:
        alone = lambda s: F.when(F.length(chunk) < SHORT, state_of(s["done"], s["last"], chunk)).otherwise(state_of(one_more(s), chunk, nothing))
        freed = F.when(state["held"].isNull(), state).otherwise(state_of(one_more(state), state["held"], nothing))
        return F.when(joins(state["held"], chunk), state_of(one_more(state), _beside(state["held"], chunk), nothing)).otherwise(T.let(freed, alone))

    def finish(state: Column) -> Column:
        last, held = state["last"], state["held"]
        back = (F.length(held) < SHORT_LAST) & joins(last, held)
        return F.when(F.coalesce(back, F.lit(False)), F.array(_beside(last, held))).otherwise(F.filter(F.array(last, held), lambda x: x.isNotNull()))

    return in_blocks(chunks, state_of(_none(), nothing, nothing), step, finish)


def dialogue_array(text: Column, limit: int = 249) -> Column:
    def of(even: Column) -> Column:
        sentences = F.filter(T.split_dialogue_sentences(even, even=True), lambda s: s != "")
        clean = F.filter(T.let(grown(sentences, limit), lambda chunks: merged(chunks, limit)), lambda c: c != "")
        return F.flatten(F.transform(clean, lambda c: F.when(F.length(c) <= limit, F.array(c)).otherwise(lines(T.words(c, even=True), limit))))

    return T.let(T.collapse_ws(T.strip_edges(text)), of)
