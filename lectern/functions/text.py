"""Text functions, Column to Column. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: What a Unicode-aware splitter takes for white space, as a Java character class.
WS = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space that is not one plain space: what has to change for texts to have single spaces.
UNEVEN = f"(?:{WS.replace(' ', '', 1)}{WS}*| {WS}+)"
#: The same as signs, and what of them is neither a space nor a newline.
WS_SIGNS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A class of many ranges is slow, so signs of the first are left by a look at that alone.
RARE_WS = r"(?![ -~\n])(?![\u00a1-\u167f])" + WS.replace("\\t-\\r", "\\t\\x0b-\\r").replace(" ", "", 1)
WORDS_PER_MINUTE = 150

# Abbreviations and their readings.
ABBREVIATIONS = (("e.g.", "for example"), ("i.e.", "that is"), ("etc.", "and so on"), ("vs.", "versus"), ("Dr.", "Doctor"), ("Mr.", "Mister"), ("Mrs.", "Missus"), ("Ms.", "Miss"))
SPEECH_ABBREVIATIONS = (
    ("Dr.", "Doctor"), ("Mr.", "Mister"), ("Mrs.", "Missus"), ("Ms.", "Miss"), ("Prof.", "Professor"), ("etc.", "and so on"),
    ("e.g.", "for example"), ("i.e.", "that is"), ("vs.", "versus"), ("Inc.", "Incorporated"), ("Ltd.", "Limited"), ("Corp.", "Corporation"),
)
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
# Words and how they are to be spoken.
PRONUNCIATION = (
    ("atheist", "aytheeist"), ("atheists", "aytheeists"), ("atheism", "aytheeism"), ("Jehovah's", "jehovas"), ("colonel", "kernel"),
    ("hierarchy", "hiyerarkey"), ("epitome", "ihpitomee"), ("hyperbole", "hyperbolee"), ("cache", "cash"), ("niche", "neesh"),
    ("facade", "fasahd"), ("gauge", "gayj"), ("receipt", "reeseet"), ("height", "hite"), ("leisure", "leezhur"),
    ("bourgeois", "boorzhwah"), ("rendezvous", "rondayvoo"), ("regime", "rehzheem"), ("fascism", "fashism"), ("Nazi", "notsee"),
    ("Nazis", "notsees"), ("Aryan", "airy an"), ("pundits", "pundits"), ("ambiguous", "ambigyoous"), ("Christianity", "christianity"),
    ("religious", "rihliljus"), ("Worcester", "wuster"), ("Leicester", "lester"), ("Arkansas", "arkansaw"),
)
#: The shorter dictionary of the speech step leaves these out.
SHORT_PRONUNCIATION = tuple(p for p in PRONUNCIATION if p[0] not in ("Aryan", "pundits", "ambiguous", "Christianity", "religious"))
# Contractions and their long forms.
CONTRACTIONS = (
    ("don't", "do not"), ("won't", "will not"), ("can't", "cannot"), ("shouldn't", "should not"), ("wouldn't", "would not"),
    ("couldn't", "could not"), ("hasn't", "has not"), ("haven't", "have not"), ("isn't", "is not"), ("aren't", "are not"),
    ("wasn't", "was not"), ("weren't", "were not"), ("I'm", "I am"), ("you're", "you are"), ("we're", "we are"),
    ("they're", "they are"), ("it's", "it is"), ("that's", "that is"), ("I'll", "I will"), ("you'll", "you will"),
    ("we'll", "we will"), ("they'll", "they will"), ("I'd", "I would"), ("you'd", "you would"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced(text: Column, sign: str, other: str) -> Column:
    """A plain sign by another, where a search, which is cheaper, finds it."""
    return let(text, lambda t: F.when(t.contains(sign), F.replace(t, F.lit(sign), F.lit(other))).otherwise(t))


def quoted(word: str) -> str:
    """A word as a Java pattern that matches it alone."""
    return "".join(c if c.isalnum() or c in " '" else "\\" + c for c in word)


_EDGE = re.compile(r"\b")


def _met_within(word: str, text: str) -> bool:
    """Whether ``word`` can be met in a text that holds ``text`` whole, sharing some of it: within it, or
    across one of its ends."""
    cuts = [m.start() for m in _EDGE.finditer(word)]
    if any(text.startswith(word, m.start()) and _EDGE.match(text, m.start() + len(word)) for m in _EDGE.finditer(text)):
        return True
    inner = [i for i in cuts if 0 < i < len(word)]
    ends = lambda part: text.endswith(part) and _EDGE.match(text, len(text) - len(part))
    starts = lambda part: text.startswith(part) and _EDGE.match(text, len(part))
    return any(ends(word[:i]) or starts(word[i:]) for i in inner)


def independent(pairs: Sequence[tuple[str, str]]) -> bool:
    """Whether replacing the words in turn is the same as replacing all at once: words and readings begin
    and end in letters (so a reading leaves the boundaries of its neighbours as they are), no two words
    share signs of a text, and no reading makes a later word, alone or with what stands beside it."""
    folded = [(word.upper().lower(), reading.upper().lower()) for word, reading in pairs]
    whole = all(s and s[0].isalpha() and s[-1].isalpha() for pair in pairs for s in pair)
    apart = len({w for w, _ in folded}) == len(folded) and not any(_met_within(u, w) for w, _ in folded for u, _ in folded if u != w)
    return whole and apart and not any(_met_within(u, reading) for i, (_, reading) in enumerate(folded) for u, _ in folded[i + 1 :])


def beginning(words: Sequence[str]) -> str:
    """A look at the next sign, whether one of the words can begin with it: a letter in either case, or one
    that only folds to it."""
    first = {word[0].lower() for word in words}
    signs = [chr(c) for c in range(0x3000) if chr(c).lower() in first or chr(c).upper().lower() in first or chr(c).lower()[:1] in first]
    return f"(?=[{''.join(map(quoted, signs))}])"


def any_of(pairs: Sequence[tuple[str, str]]) -> str:
    """A pattern of all words, whole and without regard to case, tried only where one can begin."""
    return rf"{beginning([word for word, _ in pairs])}(?iU)\b(?:{'|'.join(quoted(word) for word, _ in pairs)})\b"


def mentions(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Whether any of the words may be there: a plain search, which spares most texts a pass for each.
    Words that all end in a period are looked for at periods."""
    if all(word[-1] == "." for word, _ in pairs):
        return text.rlike(rf"\.(?<=(?iU)(?:{'|'.join(quoted(word) for word, _ in pairs)}))")
    return let(folded_word(text), lambda folded: reduce(or_, [folded.contains(word.lower()) for word, _ in pairs]))


def folded_word(word: Column) -> Column:
    """Words of ASCII letters in small ones, whatever letters a pattern without regard to case takes for
    them: the two odd i, the long s and the sign for kelvin."""
    for sign, letter in zip("\u0130\u0131\u017f\u212a", "iisk"):
        word = replaced(word, sign, letter)
    return F.lower(word)


def _readings(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.str_to_map(F.lit("\x02".join(f"{word.upper().lower()}\x01{reading}" for word, reading in pairs)), F.lit("\x02"), F.lit("\x01"))


def fold_words(text: Column, pairs: Sequence[tuple[str, str]], strict: bool = True) -> Column:
    """Replaces each word in turn, whole and without regard to case; later pairs see what earlier
    ones wrote. ``strict`` asks for a word boundary after the word even where the word ends in a
    period; otherwise only that no word goes on there.

    A text in which no word is met is left by one search. Where the order cannot matter
    (``independent``), all words are found by one pattern: the text is parted at its matches, and each is
    looked up."""
    end = r"\b" if strict else r"(?!\w)"

    def in_turn(t: Column) -> Column:
        for word, reading in pairs:
            t = F.regexp_replace(t, rf"{beginning([word])}(?iU)\b{quoted(word)}{end}", reading.replace("$", r"\$"))
        return t

    def at_once(t: Column) -> Column:
        met = F.regexp_extract_all(t, F.lit(any_of(pairs)), F.lit(0))
        read = F.transform(met, lambda m: F.coalesce(F.try_element_at(_readings(pairs), folded_word(m)), m))
        return F.array_join(F.zip_with(F.split(t, any_of(pairs), -1), read, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    if strict and independent(pairs):
        return let(text, lambda t: F.when(t.rlike(any_of(pairs)), at_once(t)).otherwise(t))
    return let(text, lambda t: F.when(mentions(t, pairs), in_turn(t)).otherwise(t))


# ---- cleaning -----------------------------------------------------------------------------------


def strip_edges(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_SIGNS))


def has_rare_ws(text: Column) -> Column:
    """Whether there is white space other than spaces and newlines."""
    return text.rlike(RARE_WS)


def spaces_for_ws(text: Column, rare: Column | None = None) -> Column:
    """A space for each sign of white space; rare ones are looked for before they are replaced, unless
    ``rare`` tells whether a text can have them."""
    return let(replaced(text, "\n", " "), lambda t: F.when(has_rare_ws(t) if rare is None else rare, F.regexp_replace(t, WS, " ")).otherwise(t))


def _replace_by_ws(text: Column, pattern: Callable[[str], str], to: str) -> Column:
    """Replaces a pattern that names white space: in texts without rare one it is but spaces and newlines,
    which a small class finds in a tenth of the time."""
    return let(text, lambda t: F.when(has_rare_ws(t), F.regexp_replace(t, pattern(WS), to)).otherwise(F.regexp_replace(t, pattern(r"[ \n]"), to)))


def strip_bracket_refs(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(r"\[(?U)\d+\]"), _replace_by_ws(t, lambda ws: rf"{ws}*\[(?U)\d+\]", "")).otherwise(t))


def strip_paren_numbers(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(r"\((?U)\d+\)"), _replace_by_ws(t, lambda ws: rf"{ws}*\((?U)\d+\)", "")).otherwise(t))


def strip_inline_numbers(text: Column) -> Column:
    """Numbers of up to three digits between a letter, comma or period and a space, comma or period; texts
    without a digit before one of these are left."""
    found = lambda t: t.rlike(rf"(?U)\d(?=[,.]|{WS})")
    strip = lambda t: _replace_by_ws(t, lambda ws: rf"(?U)(?={ws}|\d)(?<=[a-zA-Z,.]){ws}*\d{{1,3}}(?=[,.]|{ws})", "")
    return let(text, lambda t: F.when(found(t), strip(t)).otherwise(t))


def strip_note_lines(text: Column) -> Column:
    """Lines that start with a number and a period, with the line break before them."""
    return F.regexp_replace(text, rf"(?d)\n{WS}*\d{{1,3}}\.{WS}+.*?(?=\n|\z)", "")


def collapse_ws(text: Column) -> Column:
    return F.trim(collapse_runs(text))


def tighten_punct(text: Column) -> Column:
    return _replace_by_ws(text, lambda ws: f"{ws}+([,.!?;:])", "$1")


def sentence_space(text: Column) -> Column:
    return F.regexp_replace(text, f"([.!?]){WS}*([A-Z])", "$1 $2")


def normalize_dashes(text: Column) -> Column:
    for dash in ("—", "–", " - "):
        text = replaced(text, dash, " -- ")
    return text


def expand_abbreviations(text: Column, strict: bool = True) -> Column:
    return fold_words(text, ABBREVIATIONS, strict)


def universal_clean(text: Column, strict: bool = True) -> Column:
    """References, notes and stray numbers go, white space and punctuation are made even, dashes and
    abbreviations written out. Paragraph breaks go with the white space.

    A step is taken only where a plain search finds what it looks for, and once white space is single
    spaces the steps after rely on it: only a sign right before a capital wants a space, and none of
    them leaves two."""

    def where(found: Callable[[Column], Column], step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda t: F.when(found(t), step(t)).otherwise(t)

    def numbers(t: Column) -> Column:
        return strip_note_lines(strip_inline_numbers(t))

    steps = (
        where(lambda t: t.contains("["), strip_bracket_refs),
        where(lambda t: t.contains("("), strip_paren_numbers),
        where(lambda t: t.rlike(r"(?U)\d"), numbers),
        collapse_ws,
        where(lambda t: t.rlike(" [,.!?;:]"), lambda t: F.regexp_replace(t, " ([,.!?;:])", "$1")),
        where(lambda t: t.rlike("[.!?][A-Z]"), lambda t: F.regexp_replace(t, "([.!?])(?=[A-Z])", "$1 ")),
        normalize_dashes,
    )
    for step in steps:
        text = let(text, step)
    return strip_edges(expand_abbreviations(text, strict))


def collapse_runs(text: Column) -> Column:
    """White space as single spaces. A pattern is needed only where some is left once newlines are spaces."""
    return let(replaced(text, "\n", " "), lambda t: F.when(has_rare_ws(t), F.regexp_replace(t, UNEVEN, " ")).when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))


def apply_dictionary(text: Column, pairs: Sequence[tuple[str, str]] = PRONUNCIATION) -> Column:
    return fold_words(text, pairs)


def strip_trailing_name(text: Column, name: str | None = None) -> Column:
    """Drops a given name at the end, then any two capitalised words there."""
    if name:
        text = F.regexp_replace(text, rf"(?iU){WS}+{quoted(name)}\.?{WS}*$", "")
    return F.regexp_replace(text, rf"{WS}+[A-Z][a-z]+{WS}+[A-Z][a-z]+\.?{WS}*$", "")


def preprocess_for(target: Column, text: Column, name: str | None = None) -> Column:
    """The pronunciation dictionary for the target that needs it, the text as it is for others."""
    return F.when(F.lower(target) == "bark", strip_trailing_name(apply_dictionary(text), name)).otherwise(text)


def expand_contractions(text: Column) -> Column:
    return fold_words(text, CONTRACTIONS)


def remove_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?d)\[.*?\]", ""), r"(?d)\(.*?\)", "")


def normalize_punct(text: Column) -> Column:
    text = F.translate(text, "“”‟‘’‛", "\"\"\"'''")
    return F.regexp_replace(F.regexp_replace(text, "[—–]", " -- "), r"\.{3,}", "...")


def spell_symbols(text: Column) -> Column:
    for sign, word in (("&", " and "), ("@", " at "), ("%", " percent"), ("#", " number ")):
        text = F.replace(text, F.lit(sign), F.lit(word))
    return text


#: A digit that is a word; the boundary before it is looked at once it is met.
LONE_DIGIT = r"(?U)[0-9](?<=\b[0-9])\b"


def spell_digits(text: Column) -> Column:
    """Words for digits that stand alone. None of them changes what stands beside another, so all are found
    at once: the text is parted at them."""
    said = F.transform(F.regexp_extract_all(text, F.lit(LONE_DIGIT), F.lit(0)), lambda d: F.get(F.array(*map(F.lit, DIGIT_WORDS)), d.cast("int")))
    return F.array_join(F.zip_with(F.split(text, LONE_DIGIT, -1), said, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def normalize_for_speech(text: Column, enabled: bool = True, abbreviations: bool = True, digits: bool = False) -> Column:
    if not enabled:
        return text
    if abbreviations:
        text = fold_words(text, SPEECH_ABBREVIATIONS)
    if digits:
        text = let(text, lambda t: F.when(t.rlike(LONE_DIGIT), spell_digits(t)).otherwise(t))
    return strip_edges(collapse_runs(text))


# ---- words, sentences, paragraphs -----------------------------------------------------------------


def words(text: Column, even: bool = False) -> Column:
    """``even`` texts are known to have no white space but single spaces within."""
    return F.array_remove(F.split(text, " "), "") if even else F.array_remove(F.split(spaces_for_ws(text), " "), "")


def word_count(text: Column, rare: Column | None = None) -> Column:
    """Words are counted by the single spaces between them; ``rare`` as for ``spaces_for_ws``."""
    single = let(spaces_for_ws(text, rare), lambda t: F.trim(F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t)))
    return let(single, lambda t: F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1))


def est_minutes(text: Column, words_per_minute: int = WORDS_PER_MINUTE) -> Column:
    return word_count(text) / F.lit(words_per_minute)


def split_sentences(text: Column) -> Column:
    """Cuts at white space after a period, an exclamation or a question mark."""
    return F.split(text, rf"(?<=[.!?]){WS}+")


def split_dialogue_sentences(text: Column, even: bool = False) -> Column:
    """As above, but only where a capital or a quotation follows, and after quoted sentences. In an ``even``
    text, whose white space is single spaces, what stands around is looked at only at spaces."""
    if even:
        return F.split(text, r" (?:(?<=[.!?] )(?=[A-Z\"])|(?<=\.\" )(?=[A-Z])|(?<=\" )(?=[A-Z][a-z])|(?<=[!?]\" ))")
    cuts = (rf"(?<=[.!?]){WS}+(?=[A-Z\"])", rf"(?<=\.\"){WS}+(?=[A-Z])", rf"(?<=\"){WS}+(?=[A-Z][a-z])", rf"(?<=!\"){WS}+", rf"(?<=\?\"){WS}+")
    return F.split(text, "|".join(cuts))


def split_paragraphs(text: Column) -> Column:
    return F.split(text, rf"\n{WS}*\n")


# ---- names and previews ---------------------------------------------------------------------------


def clean_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), "_+", "_"), "^_+|_+$", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-]", "_")


def valid_name(name: Column) -> Column:
    return name.rlike(r"\A[a-zA-Z0-9_-]+\z")


def truncate_text(text: Column, n: int = 50, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - len(suffix)), F.lit(suffix)))


def text_preview(text: Column, n: int = 100) -> Column:
    """Cut at ``n``, back to the last space if that is in the last fifth."""
    cut = F.substring(text, 1, n)
    space = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(-1)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.when(space > n * 0.8, F.substr(cut, F.lit(1), space)).otherwise(cut), F.lit("...")))


# ---- checkpoint types -------------------------------------------------------------------------------

# Marks of a checkpoint type and the category they mean, first match wins.
CATEGORY_MARKS = (("PIPELINE_START", "PIPELINE"), ("PREPROCESSING", "PREPROCESS"), ("TTS", "TTS"), ("RVC", "RVC"), ("MASTER", "MASTER"), ("COMPLETE", "COMPLETE"), ("FAILED", "ERROR"), ("ERROR", "ERROR"))


def checkpoint_category(kind: Column, marks: Sequence[tuple[str, str]] = CATEGORY_MARKS) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for mark, name in marks:
        out = out.when(kind.contains(mark), name)
    return out.otherwise("OTHER")


def checkpoint_section(kind: Column) -> Column:
    """n of SECTION_<n>_<ACTION>; null where it is malformed."""
    return F.when(kind.contains("SECTION_"), F.try_element_at(F.split(kind, "_"), F.lit(2)).try_cast("int"))


def checkpoint_action(kind: Column) -> Column:
    parts = F.split(kind, "_")
    return F.when(checkpoint_section(kind).isNotNull(), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_"))


def next_action(kind: Column) -> Column:
    """What a job does next after a checkpoint."""
    n, action = checkpoint_section(kind).cast("string"), checkpoint_action(kind)
    by_action = (
        F.when(action == "START", F.concat(F.lit("TTS generation for Section "), n))
        .when(action == "TTS_COMPLETE", F.concat(F.lit("RVC processing for Section "), n))
        .when(action == "RVC_COMPLETE", F.concat(F.lit("Master combination for Section "), n))
        .when(action.isin("MASTER_COMPLETE", "MASTER_FAILED"), F.concat(F.lit("Mark Section "), n, F.lit(" complete")))
        .when(action == "COMPLETE", F.concat(F.lit("Start processing Section "), (checkpoint_section(kind) + 1).cast("string")))
        .otherwise(F.concat(F.lit("Continue Section "), n, F.lit(" processing")))
    )
    return (
        F.when(n.isNotNull(), by_action)
        .when(kind.contains("PREPROCESSING_COMPLETE"), "Start section processing loop")
        .when(kind.contains("PIPELINE_START"), "Begin preprocessing phase")
        .otherwise("Resume pipeline processing")
    )
