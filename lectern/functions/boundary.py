"""Where a text may be cut or joined without hurting its flow, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip_edges, words

# The word lists of the rules.
ARTICLES = ("a", "an", "the")
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "some", "any", "every", "each")
SHORT_PREPOSITIONS = ("of", "in", "on", "at", "by", "for", "with", "from", "to")
PREPOSITIONS = (
    "of", "in", "on", "at", "by", "for", "with", "from", "to", "into", "onto", "upon", "under", "over", "through", "between", "among",
    "during", "before", "after", "above", "below", "across", "around", "behind", "beside",
)
SHORT_CONJUNCTIONS = ("and", "but", "or", "that", "which")
CONJUNCTIONS = ("and", "but", "or", "that", "which", "who", "where", "when", "while", "although", "because", "since", "unless", "until", "whereas")
COMPOUNDS = (
    "as well", "such as", "in order", "due to", "rather than", "more than", "less than", "other than", "as soon", "so that",
    "even though", "as if", "in case", "on behalf", "according to", "in spite", "regardless of",
)
ADJECTIVE_ENDINGS = ("ic", "al", "tic", "ed", "ing", "ous", "ful", "less", "ive", "ible", "able", "ary", "ory", "ent", "ant", "ish", "like", "ly", "ese", "ine", "ile")
ADJECTIVES = ("good", "bad", "big", "small", "old", "new", "long", "short", "high", "low", "hot", "cold", "warm", "cool", "fast", "slow", "hard", "soft", "strong", "weak")
NOUN_ENDINGS = ("tion", "sion", "ment", "ness", "ity", "ty", "er", "or", "ist", "ism", "ure", "age", "ance", "ence", "ship", "hood", "dom", "ward")
TOPIC_SHIFTS = ("meanwhile", "later", "suddenly", "however", "nevertheless", "on the other hand")
TIME_SHIFTS = ("meanwhile", "later", "suddenly", "then")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def _ends(word: Column, endings: tuple[str, ...]) -> Column:
    """With more than two characters before the ending."""
    return word.rlike(r"(?s)...(?:" + "|".join(endings) + r")\z")


def _tail(w: Column) -> Column:
    return F.rtrim(F.lower(F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit(""))), F.lit('.,!?";:'))


def _head(w: Column) -> Column:
    return F.ltrim(F.lower(F.coalesce(F.try_element_at(w, F.lit(1)), F.lit(""))), F.lit('"'))


def last_word(text: Column) -> Column:
    return _tail(words(text))


def first_word(text: Column) -> Column:
    return _head(words(text))


def is_adjective_like(word: Column) -> Column:
    clean = F.regexp_replace(F.lower(word), r"[.,!?\";:]+\z", "")
    return (F.length(clean) >= 3) & (_ends(clean, ADJECTIVE_ENDINGS) | clean.isin(*ADJECTIVES))


def is_noun_like(word: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(word), r"\A\"+", ""), r"[.,!?\";:]+\z", "")
    capital = word.rlike(r"\A\p{Lu}") & (F.length(clean) > 2)
    return capital | _ends(clean, NOUN_ENDINGS) | ((F.length(clean) >= 4) & ~clean.rlike(r"(?:ly|ing|ed)\z"))


def is_safe_break(current: Column, following: Column, even: bool = False) -> Column:
    """Whether a chunk may end here: eight rules, the first that applies decides. Of ``even`` texts, whose white
    space is single spaces within, only the words next to the break are cut out."""
    starts, ends = sorted({c.split()[0] for c in COMPOUNDS}), sorted({c.split()[-1] for c in COMPOUNDS})

    def rules(x: Column) -> Column:
        last, first, said, two = x["last"], x["first"], x["said"], x["two"]
        compound = two.rlike(r"\A(?:" + "|".join(starts) + ")") & two.rlike("(?:" + "|".join(ends) + r")\z")
        return (
            F.when((x["before"] < 1) | (x["after"] < 1), True)
            .when(last.isin(*DETERMINERS) | last.isin(*PREPOSITIONS), False)
            .when(first.isin(*CONJUNCTIONS), False)
            .when(is_adjective_like(last) & is_noun_like(first), False)
            .when((x["before"] >= 2) & compound, False)
            .when(F.endswith(said, F.lit('"')), True)
            .when(F.endswith(said, F.lit(".")) & ~F.endswith(last, F.lit(".")), True)
            .when(said.contains('"'), False)
            .otherwise(True)
        )

    def seen(w: Column) -> Column:
        a, b = w["a"], w["b"]
        two = F.lower(F.array_join(F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), F.lit(2)), " "))
        return let(F.struct(_tail(a).alias("last"), _head(b).alias("first"), F.size(a).alias("before"), F.size(b).alias("after"), two.alias("two"), w["said"].alias("said")), rules)

    if even:
        last = F.rtrim(F.lower(F.substring_index(current, " ", -1)), F.lit('.,!?";:'))
        first = F.ltrim(F.lower(F.substring_index(following, " ", 1)), F.lit('"'))
        before = F.when(current == "", 0).when(current.contains(" "), 2).otherwise(1)
        two = F.lower(F.substring_index(current, " ", -2))
        return let(F.struct(last.alias("last"), first.alias("first"), before.alias("before"), F.when(following == "", 0).otherwise(1).alias("after"), two.alias("two"), current.alias("said")), rules)
    return let(F.struct(words(current).alias("a"), words(following).alias("b"), strip_edges(current).alias("said")), seen)


def is_safe_merge(a: Column, b: Column, even: bool = False) -> Column:
    """Whether two chunks may become one: across a change between speech and telling, not between two
    speeches, and not before a change of topic."""
    a, b = (a, b) if even else (strip_edges(a), strip_edges(b))
    left, right = F.endswith(a, F.lit('"')), F.startswith(b, F.lit('"'))
    return F.when(left != right, True).when(left & right, False).otherwise(~let(F.substring(F.lower(b), 1, 50), lambda start: _any(start, TOPIC_SHIFTS)))


def _points(said: Column, length: Column, a: Column, b: Column) -> Column:
    """The score from the stripped first part, its length, its words and those of the second."""
    points = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    def total(x: Column) -> Column:
        return (
            points(F.endswith(said, F.lit(".")), 2.0)
            + points(F.endswith(said, F.lit('"')), 1.5)
            + points(F.endswith(said, F.lit("!")) | F.endswith(said, F.lit("?")), 1.0)
            + points(x["last"].isin(*ARTICLES), -3.0)
            + points(x["last"].isin(*SHORT_PREPOSITIONS), -2.0)
            + points(x["first"].isin(*SHORT_CONJUNCTIONS), -1.5)
            + points(length < 30, -1.0)
        )

    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(-1.0)).otherwise(let(F.struct(_tail(a).alias("last"), _head(b).alias("first")), total))


def split_score(a: Column, b: Column) -> Column:
    """How good it is to cut between two parts; -1 if one has no words."""
    return let(F.struct(strip_edges(a).alias("said"), F.length(a).alias("n"), words(a).alias("a"), words(b).alias("b")), lambda x: _points(x["said"], x["n"], x["a"], x["b"]))


def best_split(current: Column, following: Column, max_chars: int, even: bool = False) -> Column:
    """Number of words of the first part at the best cut among the rightmost places, the rightmost of
    equals; null if none scores above -1."""

    def among(w: Column) -> Column:
        n = F.size(w)
        places = F.when(n > 2, F.sequence(n - 1, F.greatest(F.lit(1), n - 10) + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))

        def scored(i: Column) -> Column:
            first = F.array_join(F.slice(w, F.lit(1), i), " ")
            # the second part begins with a word of the chunk, so its first word is known
            cut = lambda f: F.struct(F.when(F.length(f) >= max_chars * 0.6, _points(f, F.length(f), F.slice(w, i, F.lit(1)), F.slice(w, i + 1, F.lit(1)))).alias("score"), i.alias("at"))
            return let(first, cut)

        return let(F.array_max(F.transform(places, scored)), lambda top: F.when(top["score"] > -1, top["at"]))

    return let(words(current, even), among)


def gap_after(current: Column, following: Column, sentence: float = 0.4, dramatic: float = 0.55, paragraph: float = 0.55, short: float = 0.3) -> Column:
    """Seconds of silence after a chunk, by its own end and the chunk that follows."""
    said, tail = strip_edges(current), F.lower(F.right(strip_edges(current), F.lit(20)))
    dialogue = F.endswith(said, F.lit('"')) | F.startswith(said, F.lit('"')) | tail.contains("said") | tail.contains("replied")
    opens = F.coalesce(strip_edges(following).rlike(r"\A[\"\p{Lu}]"), F.lit(False))
    shift = F.endswith(said, F.lit(".")) & opens & _any(F.substring(F.lower(following), 1, 50), TIME_SHIFTS)
    drama = said.contains("--") | F.endswith(said, F.lit("...")) | F.endswith(said, F.lit("!")) | F.endswith(said, F.lit("?"))
    return F.when(dialogue, short).when(shift, paragraph).when(drama, dramatic).when(F.endswith(said, F.lit(".")), sentence).otherwise(short)
