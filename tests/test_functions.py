"""Point tests of the functions, computed by hand from their rules."""

import html
import html.entities
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import boundary as B, signal as G, text as T, time as D
from lectern.operators import chunkers as C, dialogue, jobs
from lectern.sources import files as S


def test_references_are_those_of_html(spark):
    codes = (0, 9, 13, 38, 65, 0x80, 0x81, 0x92, 0x9F, 0xA0, 233, 0xB, 0xD800, 0xFDD0, 0xFFFF, 0x1F44D, 0x10FFFF, 0x110000, 10**7, 10**20)
    texts = ["a &middot; b&#233;&#xE9;&#X2019;&uuml;&rsquo;", "&amp;lt; &amp;#38; &amp;amp;", "&copy2 &notit; &notin; &ampx &AMP &unknown; & &; &# &#; &#x; &#xg", "&NotEqualTilde;&fjlig;", "&&lt;&#0000000000065;&#00;", "", "$1 \\ &dollar;1&bsol;"]
    texts += [f"x&#{c};y&#x{c:x};z&#{c}" for c in codes] + ["".join(f"&{n}" for n in html.entities.html5)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.decode_references(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == {t: html.unescape(t) for t in texts}
    assert value(spark, "<p>5 &middot; 6 &amp;lt; &#x2019;</p>", S.html_to_text) == "5 · 6 &lt; ’"


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.strip_bracket_refs, "a [12] b[3]", "a b"),
        (T.strip_paren_numbers, "a (12) b (c)", "a b (c)"),
        (T.strip_inline_numbers, "chapter 12 begins 3.14 x", "chapter begins. x"),
        (T.strip_inline_numbers, "in 1987 we", "in 1987 we"),
        (T.strip_note_lines, "a\n7. note here\nb", "a\nb"),
        (T.collapse_ws, " a  b\n\nc ", "a b c"),
        (T.tighten_punct, "a , b !", "a, b!"),
        (T.sentence_space, "End.Next U.S.A", "End. Next U. S. A"),
        (T.normalize_dashes, "a—b – c - d", "a -- b  --  c -- d"),
        (T.expand_abbreviations, "Dr. Smith e.g.x etc.y", "Dr. Smith for examplex and so ony"),
        (lambda t: T.expand_abbreviations(t, strict=False), "Dr. Smith, vs. me", "Doctor Smith, versus me"),
        (T.apply_dictionary, "The Colonel and the NICHE of niches", "The kernel and the neesh of niches"),
        (T.expand_contractions, "Don't say I'm", "do not say I am"),
        (T.remove_brackets, "a [b] (c) [d\ne]", "a   [d\ne]"),
        (T.normalize_punct, "“a” ‘b’ c—d.....", "\"a\" 'b' c -- d..."),
        (T.spell_symbols, "a&b 5% #1", "a and b 5 percent  number 1"),
        (lambda t: T.normalize_for_speech(t, digits=True), "Prof.x  has 7 of 12", "Professorx has seven of 12"),
        (lambda t: T.strip_trailing_name(t, "Jo Doe"), "the end. Jo Doe.", "the end."),
        (T.strip_trailing_name, "the end Anna Berg", "the end"),
        (T.word_count, " a b\nc ", 3),
        (T.split_sentences, "A b.  C? d! E", ["A b.", "C?", "d!", "E"]),
        (T.split_dialogue_sentences, 'He said. "No." She left. then', ["He said.", '"No."', "She left. then"]),
        (T.split_paragraphs, "a\n \nb\nc", ["a", "b\nc"]),
        (T.clean_filename, '__a<b>:c/"d"?*', "a_b_c_d"),
        (T.slug, "a b-é.c", "a_b-é_c"),
        (lambda t: T.truncate_text(t, 8), "abcdefghij", "abcde..."),
        (lambda t: T.text_preview(t, 20), "aaaa bbbb cccc ddd eeeeee", "aaaa bbbb cccc ddd..."),
        (lambda t: T.text_preview(t, 20), "a" * 30, "a" * 20 + "..."),
        (T.checkpoint_category, "SECTION_3_TTS_FAILED", "TTS"),
        (T.checkpoint_category, "SECTION_3_COMPLETE", "COMPLETE"),
        (T.checkpoint_section, "SECTION_x_START", None),
        (T.checkpoint_action, "SECTION_4_TTS_COMPLETE", "TTS_COMPLETE"),
        (T.next_action, "SECTION_4_MASTER_FAILED", "Mark Section 4 complete"),
        (T.next_action, "PREPROCESSING_COMPLETE", "Start section processing loop"),
        (T.next_action, "SECTION_x_START", "Resume pipeline processing"),
        (S.expand_ranges, "3-5 1 4", [1, 3, 4, 5]),
        (S.expand_ranges, "7-3", []),
        (S.expand_ranges, "a-b 3", None),
        (S.html_to_text, "<title>T</title><script>x()</script><p>a<b>b</b> &amp; c<br>d</p><!-- n -->\n e", "Tab & cd e"),
    ],
)
def test_text(spark, f, text, want):
    assert value(spark, text, f) == want


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (lambda: D.human_duration(F.lit(12.34)), "12.3s"),
        (lambda: D.human_duration(F.lit(245.0)), "4m 5s"),
        (lambda: D.human_duration(F.lit(7400.0)), "2h 3m"),
        (lambda: D.human_duration(F.lit(59.9), whole=True), "59s"),
        (lambda: D.human_duration(F.lit(60.0), summary=True), "60.0s"),
        (lambda: D.hms_centis(F.lit(3725.256)), "01:02:05.25"),
        (lambda: F.date_format(D.parse_checkpoint_ts(F.lit("2024-01-02T03:04:05Z")), "HH:mm"), "03:04"),
        (lambda: D.ts_parts(D.parse_checkpoint_ts(F.lit("2024-01-02 15:04:05")))["readable"], "Jan 02, 2024 at 03:04:05 PM"),
        (lambda: D.ts_parts(D.parse_checkpoint_ts(F.lit("soon")))["date"], "Unknown"),
    ],
)
def test_time(spark, f, want):
    assert spark.range(1).select(f().alias("v")).first()["v"] == want


WORDS = 'the of and but dark house said "yes no." end. stop! why? according to rather than meanwhile later quickly nation 12 a very big town "Go away." she left'.split()


@pytest.mark.parametrize(
    ("a", "b", "brk", "mrg", "score"),
    [
        ("we went to the", "house", False, True, -4.0),
        ("he sat down.", "Then he left.", True, True, 1.0),
        ("it was old", "and grey", False, True, -2.5),
        ("it was beautiful", "country side", False, True, -1.0),
        ("according to", "him", False, True, -3.0),
        ('"Go away."', "She left.", True, True, 0.5),
        ('"Go away."', '"No."', True, False, 0.5),
        ('she said "no and', "left", False, True, -1.0),
        ("all of it was gone by then.", "Meanwhile the town slept", True, False, 1.0),
        ("and that, as they say, was that!", "What now", False, True, 1.0),
        ("  ", "x", True, True, -1.0),
    ],
)
def test_boundaries(spark, a, b, brk, mrg, score):
    x, y = F.lit(a), F.lit(b)
    r = spark.range(1).select(B.is_safe_break(x, y).alias("brk"), B.is_safe_merge(x, y).alias("mrg"), B.split_score(x, y).alias("s")).first()
    assert (r.brk, r.mrg, r.s) == (brk, mrg, score)


def test_best_split(spark):
    current = "one two three four. five six seven the eight nine"
    r = spark.range(1).select(B.best_split(F.lit(current), F.lit("next"), 30).alias("at"), B.best_split(F.lit("one two"), F.lit("x"), 3).alias("few"), B.best_split(F.lit(current), F.lit("x"), 90).alias("short")).first()
    # behind "four." would score best, among places whose first part is long enough
    assert (r["at"], r.few, r.short) == (4, None, None)


@pytest.mark.parametrize(
    ("text", "limit", "want"),
    [
        ("", 40, []),
        ("One. Two. Three.", 40, ["One. Two. Three."]),
        ('He sat down. "Go away." She left the house and walked home.', 30, ['He sat down. "Go away."', "She left the house", "walked home."]),
        ("word " * 20, 24, ["word word word word word"] * 4),
        ("x" * 50, 20, ["x" * 50]),
    ],
)
def test_dialogue_chunks(spark, text, limit, want):
    assert value(spark, text, lambda t: dialogue.dialogue_array(t, limit)) == want


def test_short_chunks_join_a_neighbour(spark):
    chunks = ["short one", "a chunk of more than forty characters, so it stays as it is", "end."]
    many = ["s1", "s2", "s3"]
    r = spark.range(1).select(dialogue.merged(F.array(*map(F.lit, chunks)), 100).alias("a"), dialogue.merged(F.array(*map(F.lit, many)), 100).alias("b"), dialogue.merged(F.array(*map(F.lit, chunks)), 30).alias("c"), dialogue.merged(F.array(F.lit("only")), 30).alias("d")).first()
    assert r.a == [f"{chunks[0]} {chunks[1]} end."] and r.b == ["s1 s2 s3"] and r.c == chunks and r.d == ["only"]


@pytest.mark.parametrize("n", [3, 64, 65, 200, 5000])
def test_folds_in_blocks_are_folds(spark, n):
    text = " ".join(f"Sentence {i} ends here." for i in range(n))
    want, now = [], ""
    for s in (f"Sentence {i} ends here." for i in range(n)):
        if now and len(now) + 1 + len(s) > 150:
            want.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    assert value(spark, text, C.chunk_sentences_array) == [*want, now]


def test_cleaning_equals_all_steps_in_turn(spark):
    rng = random.Random(11)
    parts = ["word", "A", "Dr.", "e.g.", "[12]", "(3)", "(x)", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2003", ".", ",", " ,", "!", "?B", ".C", "—", " - ", "12", "345", "٣", "7. ", "\n7. note\n", '"', "é", ";", ": ", "\x1c", "etc. "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)]
    step_by_step = F.col("t")
    for step in (T.strip_bracket_refs, T.strip_paren_numbers, T.strip_inline_numbers, T.strip_note_lines, T.collapse_ws, T.tighten_punct, T.sentence_space, T.collapse_runs, T.normalize_dashes, T.expand_abbreviations):
        step_by_step = step(step_by_step)
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.universal_clean(F.col("t")).alias("a"), F.regexp_replace(step_by_step, f"^{T.WS}+|{T.WS}+$", "").alias("b"), F.size(T.words(F.col("t"))).alias("n"))
    rows = made.collect()
    assert [(r.t, r.a) for r in rows if r.a != r.b] == []
    assert all(r.n == len(r.t.split()) for r in rows)


def test_gap(spark):
    rows = [('He said "no"', "x", 0.3), ("It ended.", "Later we", 0.55), ("It ended.", "And so", 0.4), ("Wait...", None, 0.55), ("no end", "x", 0.3), ("as he replied.", "x", 0.3)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select("a", "want", B.gap_after(F.col("a"), F.col("b")).alias("v")).collect()
    assert [(r.a, r.v) for r in got] == [(r.a, r.want) for r in got]


def text_of(n, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "!"]) for _ in range(n))


@pytest.mark.parametrize("limit", [30, 80, 150])
def test_chunks_keep_words_and_limits(spark, limit):
    texts = [text_of(n, n) for n in (1, 5, 40, 400)] + ["x" * 200, "", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for chunker in (C.chunk_sentences, C.chunk_dialogue):
        by_doc = {}
        for r in chunker(df, max_chars=limit).orderBy("doc_id", "chunk_no").collect():
            by_doc.setdefault(r.doc_id, []).append(r.text)
            assert len(r.text) <= limit or " " not in r.text
        if chunker is C.chunk_sentences:
            assert [" ".join(by_doc.get(i, [])).split() for i in range(len(texts))] == [t.split() for t in texts]


def test_sections_keep_words(spark):
    texts = [text_of(n, n).replace(". ", ".\n\n" if n % 2 else ". ") for n in (10, 301, 900, 1500)] + ["word " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = C.split_sections(df, target_minutes=1).orderBy("doc_id", "section_no").collect()
    for i, t in enumerate(texts):
        assert " ".join(r.text for r in got if r.doc_id == i).split() == t.split()
    assert max(r.section_no for r in got if r.doc_id == 4) > 1


def test_unknown_strategy_is_an_error(spark):
    with pytest.raises(Exception, match="unknown strategy"):
        C.chunk_with(spark.createDataFrame([("a b", "nope")], "text string, strategy string"), "strategy").collect()


def test_signals(spark):
    x = [0.0, 0.005, 0.5, -1.0, 0.25, 0.0]
    df = spark.createDataFrame([(x, 2)], "s array<float>, r int")
    s, r = F.col("s"), F.col("r")
    row = df.select(G.peak_normalize(s).alias("n"), G.fade_out(s, r, 1.0).alias("f"), G.trim_silence(s).alias("t"), G.quantize_int16(s).alias("q"), G.resample_linear(s, 2.0).alias("h")).first()
    assert np.allclose(row.n, np.asarray(x) * 0.95, atol=1e-6)
    assert np.allclose(row.f, [*x[:4], 0.25, 0.0], atol=1e-6)
    assert np.allclose(row.t, x[2:5]) and row.q[:4] == [0, 163, 16383, -32767]
    assert np.allclose(row.h, [0.0025, -0.25, 0.125], atol=1e-6)
    zero = spark.createDataFrame([([0.0, 0.0], 2)], "s array<float>, r int").select(G.peak_normalize(s).alias("n"), G.trim_silence(s).alias("t")).first()
    assert zero.n == [0.0, 0.0] and zero.t == [0.0, 0.0]


DICTIONARIES = {"spoken": T.PRONUNCIATION, "short": T.SHORT_PRONUNCIATION, "long forms": T.CONTRACTIONS}


def test_independence():
    assert all(map(T.independent, DICTIONARIES.values()))
    assert not T.independent(T.ABBREVIATIONS) and not T.independent(T.SPEECH_ABBREVIATIONS)
    for pairs, told in (
        ((("a", "b"), ("b", "c")), False),  # a reading is a later word
        ((("b", "c"), ("a", "b")), True),  # an earlier one
        ((("it's", "it is"), ("s", "x")), False),  # a word within another
        ((("a", "x"), ("x's", "y")), False),  # a reading begins a later word
        ((("a", "x y"), ("z'x", "w")), False),
        ((("a'b", "x"), ("b'c", "y")), False),  # words that overlap
        ((("ab", "x"), ("bc", "y")), True),
        ((("a", "-x"),), False),  # a reading that ends otherwise
        ((("a", "x"), ("A", "y")), False),
    ):
        assert T.independent(pairs) == told, pairs


@pytest.mark.parametrize("name", sorted(DICTIONARIES))
def test_all_words_at_once_equal_words_in_turn(spark, name):
    """Random texts of the words, of parts of them, of signs beside them and of letters that only fold to
    theirs, against one replacement after another; and counts of the words against counts in turn."""
    pairs, rng = DICTIONARIES[name], random.Random(4)
    bits = [w for w, _ in pairs] + [r for _, r in pairs] + ["'", "'s", "s", " ", " ", " ", "-", ".", "_", "é", "1", "colo", "\u017f", "\u212a", "$1"]
    fold = str.maketrans({"s": "\u017f", "i": "\u0130", "k": "\u212a", "I": "\u0131"})
    texts = ["".join(rng.choice((str, str.upper, str.title, lambda w: w.translate(fold)))(rng.choice(bits)) + rng.choice(["", " ", " "]) for _ in range(14)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    in_turn = F.col("text")
    for word, reading in pairs:
        in_turn = F.regexp_replace(in_turn, rf"(?iU)\b{T.quoted(word)}\b", reading)
    rows = df.select("text", T.fold_words(F.col("text"), pairs).alias("got"), in_turn.alias("want")).collect()
    assert [(r.text, r.got) for r in rows] == [(r.text, r.want) for r in rows]
    assert sum(r.got != r.text for r in rows) > 1000
    counts = {r.word: r.hits for r in jobs.dictionary_hits(df, pairs).collect()}
    step, want = F.col("text"), []
    for word, reading in pairs:
        want.append(F.sum(F.regexp_count(step, F.lit(rf"(?iU)\b{T.quoted(word)}\b"))))
        step = F.regexp_replace(step, rf"(?iU)\b{T.quoted(word)}\b", reading)
    assert counts == dict(zip([w for w, _ in pairs], df.agg(*want).first()))


ODD_TEXTS = [
    "", " ", "\n", "a", " a  b\tc d ", "x y", "a\x1cb", "é à ü", "One. Two!  Three?\nFour. ", ". a", "a. ", "see 12, then 3. And 45 .", "a 7,b", "é 5 ç 6.7 8", "0́ 1 2a _3 4", "٣ 7 9",
    "Dr. Who, DR. no; dr.x e.g.y E.G. ı.e. vſ. İ.e.", "Prof. Inc. Ltd. corp.", "ref [1] [٣]  (2) [3]", "a  , b \n. c ! d ;", "— – - x - y", "Page 3\n12\nab\n Page\x013 of\nabc  d\n٣٤٥\n a\x01b \np. 9\nP. 12\npaged\n\n  \nlast\x02",
]


def test_quick_steps_equal_the_patterns_alone(spark):
    """Steps that look first, or have a smaller pattern for plain texts, give what one pattern a step gives."""
    t, ws = F.col("t"), T.WS
    in_turn = t
    for i, word in enumerate(T.DIGIT_WORDS):
        in_turn = F.regexp_replace(in_turn, rf"(?U)\b{i}\b", word)
    speech, loose = t, t
    for word, reading in T.SPEECH_ABBREVIATIONS:
        speech = F.regexp_replace(speech, rf"(?iU)\b{T.quoted(word)}\b", reading)
    for word, reading in T.ABBREVIATIONS:
        loose = F.regexp_replace(loose, rf"(?iU)\b{T.quoted(word)}(?!\w)", reading)
    uneven = f"(?:{ws.replace(' ', '', 1)}{ws}*| {ws}+)"
    pairs = {
        "digits": (F.when(t.rlike(T.LONE_DIGIT), T.spell_digits(t)).otherwise(t), in_turn),
        "speech": (T.fold_words(t, T.SPEECH_ABBREVIATIONS), speech),
        "loose": (T.expand_abbreviations(t, strict=False), loose),
        "brackets": (T.strip_bracket_refs(t), F.regexp_replace(t, rf"{ws}*\[(?U)\d+\]", "")),
        "parens": (T.strip_paren_numbers(t), F.regexp_replace(t, rf"{ws}*\((?U)\d+\)", "")),
        "inline": (T.strip_inline_numbers(t), F.regexp_replace(t, rf"(?<=[a-zA-Z,.]){ws}*(?U)\d{{1,3}}(?=(?:{ws}|[,.]))", "")),
        "runs": (T.collapse_runs(t), F.regexp_replace(t, uneven, " ")),
        "tight": (T.tighten_punct(t), F.regexp_replace(t, f"{ws}+([,.!?;:])", "$1")),
        "dashes": (T.normalize_dashes(t), F.replace(F.replace(F.replace(t, F.lit("—"), F.lit(" -- ")), F.lit("–"), F.lit(" -- ")), F.lit(" - "), F.lit(" -- "))),
        "count": (T.word_count(t).cast("string"), F.size(F.array_remove(F.split(F.regexp_replace(t, ws, " "), " "), "")).cast("string")),
    }
    made = spark.createDataFrame([(x,) for x in ODD_TEXTS], "t string")
    for name, (quick, plain) in pairs.items():
        for row in made.select("t", quick.alias("a"), plain.alias("b")).collect():
            assert row.a == row.b, (name, row)


def test_artifact_lines_equal_each_line_alone(spark):
    from lectern.sources import files as S

    made = spark.createDataFrame([(x,) for x in [*ODD_TEXTS, None]], "t string")
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
    clean = lambda s: T.strip_edges(F.regexp_replace(F.trim(F.regexp_replace(s, T.UNEVEN, " ")), control, ""))
    keep = lambda s: (F.length(s) >= 3) & ~s.rlike(r"(?U)\A\d+\z") & ~s.rlike(rf"(?i)\A(?:page|p\.){T.WS}*\d+")
    want = made.select(F.array_join(F.filter(F.transform(F.split("t", "\n"), clean), keep), " ").alias("t")).filter("t <> ''")
    got = S.page_artifact_filter(made, "t", mode="line")
    assert sorted(r.t for r in got.collect()) == sorted(r.t for r in want.collect())


def test_even_texts_have_the_same_breaks(spark):
    """what the dialogue chunker does with single spaces alone is what the general functions do."""
    parts = ["", "a", '"He said."', "the", "a good nation.", "Meanwhile it rained", "in order to go", "5 as well", '"No!"', "very old and", "Suddenly 12", "x " * 20 + "end. 9", 'Why? "Yes!" he did', "É. Über"]
    pairs = spark.createDataFrame([(x.strip(), y.strip()) for x in parts for y in parts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    names = ("is_safe_break", "is_safe_merge")
    two = [getattr(B, n)(a, b, even=e).alias(f"{n}_{e}") for n in names for e in (False, True)]
    two += [B.best_split(a, b, 30, even=e).alias(f"best_split_{e}") for e in (False, True)]
    two += [T.split_dialogue_sentences(F.concat_ws(" ", a, b), even=e).alias(f"sentences_{e}") for e in (False, True)]
    for row in pairs.select("a", "b", *two).collect():
        for n in (*names, "best_split", "sentences"):
            assert row[f"{n}_True"] == row[f"{n}_False"], (n, row)


def test_long_words_of_digits_stay_whole_in_dialogue(spark):
    words = [f"{i}{i + 1}" for i in range(200)]
    made = spark.createDataFrame([(" ".join(words),)], "t string").select(dialogue.dialogue_array(F.col("t"), 60).alias("c")).first()
    assert " ".join(made.c).split(" ") == words and max(map(len, made.c)) <= 60


def test_the_dialogue_chunker_evens_white_space_once(spark):
    """rare white space is looked for in the whole text, not in every sentence and chunk."""
    made = spark.range(1).select(dialogue.dialogue_array(F.lit("a").substr(F.lit(1), F.col("id").cast("int"))).alias("c"))
    assert made._jdf.queryExecution().analyzed().toString().count("\\u3000") <= 4
