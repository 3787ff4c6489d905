"""Chunkers: a text column becomes rows of sections or chunks.

Greedy packing is a fold over units (sentences, paragraphs, words) that are tagged beforehand with
what joins them to the unit before and whether they must start anew. The fold is a built-in
higher-order function, so a document is one row all the way and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

#: Units of a block, at least.
BLOCK = 64


def in_blocks(items: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """``F.aggregate`` of a state whose field ``done`` (an array) only grows. A fold copies its state at
    every step, so the items are folded in blocks of about the root of their number, each with a
    ``done`` of its own: the cost is nearly in proportion to them, not to their square. No items give
    an empty array."""
    def of(all_items: Column) -> Column:
        n = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(all_items))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_items) / n).cast("int") - 1), lambda i: F.slice(all_items, i * n + 1, n))
        outer = F.struct(F.array().cast("array<array<string>>").alias("blocks"), start.alias("state"))

        def of_block(before: Column, block: Column) -> Column:
            end = lambda s: F.struct(F.concat(before["blocks"], F.array(s["done"])).alias("blocks"), s.withField("done", F.array().cast("array<string>")).alias("state"))
            return F.aggregate(block, before["state"], step, end)

        last = lambda s: F.concat(F.flatten(s["blocks"]), finish(s["state"]))
        return F.when(F.size(all_items) > 0, F.aggregate(blocks, outer, of_block, last)).otherwise(F.array().cast("array<string>"))

    return T.let(items, of)


def _fold(units: Column, fits: Callable[[Column, Column], Column], close: Callable[[Column, Column], Column] | None = None) -> Column:
    """Packs units ``struct(s, glue, size, fresh)``. ``fits``: whether a unit may join what is being
    packed; ``close``: whether the pack ends after the unit."""

    def state_of(done: Column, now: Column, size: Column) -> Column:
        return F.struct(done.alias("done"), now.alias("now"), size.alias("size"))

    def closed(state: Column) -> Column:
        return F.concat(state["done"], F.array(state["now"]))

    def step(state: Column, unit: Column) -> Column:
        joined = state_of(state["done"], F.concat(state["now"], unit["glue"], unit["s"]), state["size"] + unit["size"])
        first = state_of(state["done"], unit["s"], unit["size"])
        return F.when(state["now"] == "", first).when(~unit["fresh"] & fits(state, unit), joined).otherwise(state_of(closed(state), unit["s"], unit["size"]))

    def step_and_close(state: Column, unit: Column) -> Column:
        return T.let(step(state, unit), lambda s: F.when(close(s["now"], unit), state_of(closed(s), F.lit(""), F.lit(0))).otherwise(s))

    def finish(state: Column) -> Column:
        return F.when(state["now"] == "", F.array().cast("array<string>")).otherwise(F.array(state["now"]))

    start = state_of(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    return in_blocks(units, start, step if close is None else step_and_close, finish)


def _unit(s: Column, glue: str, size: Column, fresh: Column | None = None, **more: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(glue).alias("glue"), size.cast("int").alias("size"), (F.lit(False) if fresh is None else fresh).alias("fresh"), *[v.alias(k) for k, v in more.items()])


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, T.strip_edges), lambda s: s != "")


def _stripped_sentences(parts: Column) -> Column:
    """The same for what ``split_sentences`` gives: only the first can begin, only the last end in white space."""
    def ends(p: Column) -> Column:
        return F.transform(p, lambda s, i: F.when((i == 0) | (i == F.size(p) - 1), T.strip_edges(s)).otherwise(s))

    return F.filter(T.let(parts, ends), lambda s: s != "")


def _by_words(parts: Column, glue: str, limit: Column, rare: Column) -> Column:
    """``rare``: whether the text that the parts, stripped, are of has rare white space."""
    units = F.transform(parts, lambda s: _unit(s, glue, T.word_count(s, rare)))
    return _fold(units, lambda state, unit: (state["size"] == 0) | (state["size"] + unit["size"] <= limit))


def sections_by_paragraph(text: Column, target: Column, n: Column) -> Column:
    """Paragraphs packed up to 1.3 times the target number of words; none unless there are two
    paragraphs and at least four fifths of the wanted sections."""
    none = F.array().cast("array<string>")
    enough = lambda packed: F.when(F.size(packed) >= n * 0.8, packed).otherwise(none)
    some = lambda parts: T.let(T.has_rare_ws(text), lambda rare: T.let(_by_words(_stripped(parts), "\n\n", target * 1.3, rare), enough))
    return T.let(T.split_paragraphs(text), lambda parts: F.when(F.size(parts) >= 2, some(parts)).otherwise(none))


def sections_by_sentence(text: Column, target: Column, n: Column) -> Column:
    """Sentences packed up to 1.2 times the target; none if there are fewer sentences than sections."""
    some = lambda parts: T.let(T.has_rare_ws(text), lambda rare: _by_words(_stripped_sentences(parts), " ", target * 1.2, rare))
    return T.let(T.split_sentences(text), lambda parts: F.when(F.size(parts) >= n, some(parts)).otherwise(F.array().cast("array<string>")))


def sections_by_words(text: Column, target: Column) -> Column:
    def runs(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / target).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * target + 1, target), " "))
        return F.when(F.size(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    return T.let(T.words(text), runs)


def section_array(text: Column, target_minutes: float) -> Column:
    """Sections of about so many minutes of speech: one if the text is short enough, else by
    paragraphs, sentences or words, whichever first gives sections. What the folds compare with is
    computed once for a document, not at every step."""

    def cut(one: Column) -> Column:
        t, n, target = one["text"], one["n"], one["target"]
        some = lambda parts, other: F.when(F.size(parts) > 0, parts).otherwise(other)
        by_sentence = T.let(sections_by_sentence(t, target, n), lambda parts: some(parts, sections_by_words(t, target)))
        return T.let(sections_by_paragraph(t, target, n), lambda parts: some(parts, by_sentence))

    def sized(one: Column) -> Column:
        minutes = one["words"] / F.lit(T.WORDS_PER_MINUTE)
        n = F.greatest(F.lit(2), (minutes / target_minutes).cast("int") + 1)
        several = T.let(F.struct(one["text"].alias("text"), n.alias("n"), F.floor(one["words"] / n).cast("int").alias("target")), cut)
        return F.when(minutes <= target_minutes, F.array(one["text"])).otherwise(several)

    return T.let(text, lambda t: T.let(F.struct(t.alias("text"), T.word_count(t).alias("words")), sized))


def chunk_sentences_array(text: Column, max_chars: int = 150) -> Column:
    """Sentences packed to ``max_chars``; a longer sentence is packed by words, and its tail goes on
    being packed. A single longer word stays whole."""
    # as many words as fit, or one that does not
    line = rf"(?s)[^ ](?:.{{0,{max_chars - 2}}}[^ ])?(?= |\z)|[^ ]+" if max_chars > 1 else "[^ ]+"

    def units(s: Column) -> Column:
        lines = F.regexp_extract_all(T.collapse_ws(s), F.lit(line), F.lit(0))
        return F.when(F.length(s) > max_chars, F.transform(lines, lambda w, i: _unit(w, " ", F.length(w), i == 0))).otherwise(F.array(_unit(s, " ", F.length(s))))

    flat = F.flatten(F.transform(_stripped_sentences(T.split_sentences(text)), units))
    return _fold(flat, lambda state, unit: F.length(state["now"]) + 1 + unit["size"] <= max_chars)


def _paragraph_units(text: Column, max_chars: int) -> Column:
    def units(p: Column) -> Column:
        inner = F.transform(T.split_sentences(p), lambda s: _unit(s, " ", F.length(s), ends=F.lit(False)))
        return F.when(F.length(p) > max_chars, inner).otherwise(F.array(_unit(p, "\n\n", F.length(p), ends=F.lit(True))))

    return F.flatten(F.transform(_stripped(T.split_paragraphs(text)), units))


def chunk_paragraphs_array(text: Column, max_chars: int = 4000) -> Column:
    """Paragraphs packed to ``max_chars``, those of long ones by sentence; a text that fits is one
    chunk as it is, a longer sentence stays whole."""
    packed = _fold(_paragraph_units(text, max_chars), lambda state, unit: F.length(state["now"]) + unit["size"] + F.length(unit["glue"]) <= max_chars)
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.transform(packed, T.strip_edges))


def chunk_paragraphs_eager_array(text: Column, max_chars: int = 1000) -> Column:
    """The same without the short cut; a chunk ends as soon as a paragraph brings it to four fifths."""
    packed = _fold(
        _paragraph_units(text, max_chars),
        lambda state, unit: F.length(state["now"]) + unit["size"] + F.length(unit["glue"]) <= max_chars,
        lambda now, unit: unit["ends"] & (F.length(now) >= max_chars * 0.8),
    )
    return F.transform(packed, T.strip_edges)


def exploded(df: DataFrame, parts: Column, number: str, text: str = "text") -> DataFrame:
    """A row for each part, numbered from 1; documents without parts give none."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(parts).alias("_at", text)).select(*kept, (F.col("_at") + 1).alias(number), text)


def exploded_pairs(df: DataFrame, parts: Column, number: str, text: str = "text", following: str = "following") -> DataFrame:
    """A row for each part but the last, numbered from 1, with the part that follows: both are in the
    document's array, so nothing is shuffled or sorted to bring them together."""
    kept = [c for c in df.columns if c != text]
    pairs = T.let(parts, lambda p: F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get(p, i + 1).alias("b"))))
    return df.select(*kept, F.posexplode(pairs).alias("_at", "_pair")).select(*kept, (F.col("_at") + 1).alias(number), F.col("_pair.a").alias(text), F.col("_pair.b").alias(following))


def split_sections(df: DataFrame, text: str = "text", target_minutes: float = 30) -> DataFrame:
    return exploded(df, section_array(F.col(text), target_minutes), "section_no", text)


def chunk_sentences(df: DataFrame, text: str = "text", max_chars: int = 150) -> DataFrame:
    return exploded(df, T.let(F.col(text), lambda t: chunk_sentences_array(t, max_chars)), "chunk_no", text)


def chunk_paragraphs(df: DataFrame, text: str = "text", max_chars: int = 4000) -> DataFrame:
    return exploded(df, T.let(F.col(text), lambda t: chunk_paragraphs_array(t, max_chars)), "chunk_no", text)


def chunk_paragraphs_eager(df: DataFrame, text: str = "text", max_chars: int = 1000) -> DataFrame:
    return exploded(df, T.let(F.col(text), lambda t: chunk_paragraphs_eager_array(t, max_chars)), "chunk_no", text)


def chunk_dialogue(df: DataFrame, text: str = "text", max_chars: int = 249) -> DataFrame:
    """Dialogue-aware chunks, by the rules in ``operators.dialogue``; documents stay where they are."""
    return exploded(df, T.let(F.col(text), lambda t: _dialogue(t, max_chars)), "chunk_no", text)


STRATEGIES: dict[str, Callable[..., Column]] = {}


def register_strategy(name: str, chunker: Callable[..., Column]) -> None:
    """``chunker`` takes a text column and ``max_chars`` and gives an array of chunks: a composition of
    functions, or a call of a user's own."""
    STRATEGIES[name] = chunker


def available() -> list[str]:
    return sorted(STRATEGIES)


def _dialogue(text: Column, max_chars: int = 249) -> Column:
    from .dialogue import dialogue_array

    return dialogue_array(text, min(max_chars, 249))


for _name, _chunker in (("sentences", chunk_sentences_array), ("paragraphs", chunk_paragraphs_array), ("paragraphs_eager", chunk_paragraphs_eager_array), ("dialogue", _dialogue)):
    register_strategy(_name, _chunker)


def chunk_with(df: DataFrame, strategy: str, text: str = "text", **options: int) -> DataFrame:
    """Each row by the strategy that its column ``strategy`` names, in one pass over the rows. Unknown
    names are an error when their rows are met, before any output is made of them."""
    t = F.col(text)
    unknown = F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce(F.col(strategy), F.lit("null")))).cast("array<string>")
    parts = F.when(F.lit(False), F.array().cast("array<string>"))
    for name in available():
        parts = parts.when(F.col(strategy) == name, STRATEGIES[name](t, **options))
    return exploded(df, parts.otherwise(unknown), "chunk_no", text)
