"""Queries on texts: cleaning, counting, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import boundary as B, text as T
from ..operators import chunkers as C, jobs, joins
from ..sources import files as S
from ..sources.scratch import scratch_folder
from .fixtures import NOISY, PARAGRAPHS, derived
from .registry import query, table


def _inline(expr: str, n: int = 1) -> str:
    for _ in range(n):
        expr = rf"regexp_replace({expr}, '([a-zA-Z,.])\s*\d{{1,3}}([\s,.])', '\1\2', 'g')"
    return expr


def _fold_sql(expr: str, pairs, end: str = r"\b") -> str:
    for word, reading in pairs:
        pattern = "".join(c if c.isalnum() or c == " " else "''" if c == "'" else "\\" + c for c in word)
        expr = rf"regexp_replace({expr}, '\b{pattern}{end}', '{reading}', 'gi')"
    return expr


_STEPS = {
    "bracket": r"regexp_replace({}, '\s*\[\d+\]', '', 'g')",
    "paren": r"regexp_replace({}, '\s*\(\d+\)', '', 'g')",
    "notes": r"regexp_replace({}, '\n\s*\d{{1,3}}\.\s+[^\n]*', '', 'g')",
    "ws": r"trim(regexp_replace({}, '\s+', ' ', 'g'))",
    "tight": r"regexp_replace({}, '\s+([,.!?;:])', '\1', 'g')",
    "space": r"regexp_replace({}, '([.!?])\s*([A-Z])', '\1 \2', 'g')",
    "runs": r"regexp_replace({}, '\s+', ' ', 'g')",
    "dashes": "replace(replace(replace({}, '—', ' -- '), '–', ' -- '), ' - ', ' -- ')",
}


def _clean_sql(expr: str = "text") -> str:
    expr = _STEPS["paren"].format(_STEPS["bracket"].format(expr))
    expr = _STEPS["notes"].format(_inline(expr, 2))
    for step in ("ws", "tight", "space", "runs", "dashes"):
        expr = _STEPS[step].format(expr)
    return rf"regexp_replace({_fold_sql(expr, T.ABBREVIATIONS)}, '^\s+|\s+$', '', 'g')"


CLEAN_SQL = _clean_sql()
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))"


@query(f"SELECT doc_id, {CLEAN_SQL} AS clean_text FROM {{NOISY}}")
def str_universal_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NOISY).select("doc_id", T.universal_clean(F.col("text")).alias("clean_text"))


@query(
    f"""SELECT doc_id, {_STEPS['bracket'].format('text')} AS no_refs, {_STEPS['paren'].format('text')} AS no_numbers, {_inline('text', 2)} AS no_inline,
    {_STEPS['notes'].format('text')} AS no_notes, {_STEPS['ws'].format('text')} AS even, {_STEPS['tight'].format('text')} AS tight, {_STEPS['space'].format('text')} AS spaced,
    {_STEPS['dashes'].format('text')} AS dashes, {_fold_sql('text', T.ABBREVIATIONS)} AS written_out FROM {{NOISY}}"""
)
def str_cleaning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine texts are written for each, so that the texts are not shuffled as well where files are enough."""
    t = F.col("text")
    return derived(spark, sf_dir, NOISY, bounded=False).select(
        "doc_id", T.strip_bracket_refs(t).alias("no_refs"), T.strip_paren_numbers(t).alias("no_numbers"), T.strip_inline_numbers(t).alias("no_inline"),
        T.strip_note_lines(t).alias("no_notes"), T.collapse_ws(t).alias("even"), T.tighten_punct(t).alias("tight"), T.sentence_space(t).alias("spaced"),
        T.normalize_dashes(t).alias("dashes"), T.expand_abbreviations(t).alias("written_out"),
    )


def _loose_sql(expr: str) -> str:
    for word, reading in T.ABBREVIATIONS:
        for _ in range(2):  # what ends one match may stand before the next
            expr = rf"regexp_replace({expr}, '\b{word.replace('.', chr(92) + '.')}(\W|$)', '{reading}\1', 'gi')"
    return expr


@query(f"SELECT doc_id, {_loose_sql('text')} AS written_out FROM {{NOISY}}")
def str_loose_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations written out wherever no word goes on after them."""
    return derived(spark, sf_dir, NOISY).select("doc_id", T.expand_abbreviations(F.col("text"), strict=False).alias("written_out"))


@query(f"SELECT doc_id, {_fold_sql('text', T.PRONUNCIATION)} AS spoken, {_fold_sql('text', T.CONTRACTIONS)} AS long_forms FROM {{NOISY}}")
def str_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return derived(spark, sf_dir, NOISY).select("doc_id", T.apply_dictionary(t).alias("spoken"), T.expand_contractions(t).alias("long_forms"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\[[^\]\n]*\]', '', 'g'), '\([^)\n]*\)', '', 'g') AS no_brackets,
    regexp_replace(regexp_replace(translate(text, '“”‟‘’‛', repeat(chr(34), 3) || repeat(chr(39), 3)), '[—–]', ' -- ', 'g'), '\.{3,}', '...', 'g') AS plain_signs,
    replace(replace(replace(replace(text, '&', ' and '), '@', ' at '), '%', ' percent'), '#', ' number ') AS spelled FROM {NOISY}"""
)
def str_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return derived(spark, sf_dir, NOISY).select("doc_id", T.remove_brackets(t).alias("no_brackets"), T.normalize_punct(t).alias("plain_signs"), T.spell_symbols(t).alias("spelled"))


def _digits_sql(expr: str) -> str:
    for i, word in enumerate(T.DIGIT_WORDS):
        expr = rf"regexp_replace({expr}, '\b{i}\b', '{word}', 'g')"
    return expr


@query(rf"SELECT doc_id, trim(regexp_replace({_digits_sql(_fold_sql('text', T.SPEECH_ABBREVIATIONS))}, '\s+', ' ', 'g')) AS speech FROM {{NOISY}}")
def str_normalize_for_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NOISY).select("doc_id", T.normalize_for_speech(F.col("text"), digits=True).alias("speech"))


@query(
    rf"""SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace({_fold_sql('text', T.PRONUNCIATION)}, '\s+[A-Z][a-z]+\s+[A-Z][a-z]+\.?\s*$', '') ELSE text END AS prepared FROM {{NOISY}}"""
)
def str_preprocess_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("lang") == "en", "bark").otherwise("edge")
    return derived(spark, sf_dir, NOISY).select("doc_id", T.preprocess_for(target, F.col("text")).alias("prepared"))


@query(
    rf"""SELECT doc_id, {_WORDS.format('text')}::INT AS words, {_WORDS.format('text')} / 150.0::DOUBLE AS minutes, len({_SENTENCES.format('text')})::INT AS sentences,
    len(regexp_split_to_array(text, '\n\s*\n'))::INT AS paragraphs FROM {{PARAGRAPHS}}"""
)
def str_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return derived(spark, sf_dir, PARAGRAPHS).select("doc_id", T.word_count(t).alias("words"), T.est_minutes(t).alias("minutes"), F.size(T.split_sentences(t)).alias("sentences"), F.size(T.split_paragraphs(t)).alias("paragraphs"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '_') AS file_name, regexp_replace(text, '[^\p{L}\p{N}_\-]', '_', 'g') AS slug,
    regexp_full_match(lang || source, '[a-zA-Z0-9_-]+') AS valid, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS short,
    CASE WHEN length(text) <= 100 THEN text WHEN instr(reverse(substr(text, 1, 100)), ' ') BETWEEN 1 AND 19 THEN substr(text, 1, 100 - instr(reverse(substr(text, 1, 100)), ' ')::INT) || '...' ELSE substr(text, 1, 100) || '...' END AS preview
    FROM {NOISY}"""
)
def str_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return derived(spark, sf_dir, NOISY).select(
        "doc_id", T.clean_filename(t).alias("file_name"), T.slug(t).alias("slug"), T.valid_name(F.concat("lang", "source")).alias("valid"), T.truncate_text(t, 40).alias("short"), T.text_preview(t, 100).alias("preview")
    )


_TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g'), '(?s)</?[A-Za-z][^>]*>', '', 'g')"


#: The character references in the given pages; the last may lack its semicolon.
_REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"))


def _entities_sql(expr: str) -> str:
    for name, sign in _REFERENCES:
        expr = f"replace({expr}, '{name}', chr({ord(sign)}))"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


_HTML = rf"array_to_string(list_filter(list_transform(flatten(list_transform(string_split({_entities_sql(_TAGS)}, chr(10)), lambda l: string_split(trim(l), '  '))), lambda p: trim(p)), lambda p: p <> ''), ' ')"


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def src_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spread(table(spark, sf_dir, "pages")).select("page_id", S.html_to_text(F.col("html")).alias("text"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def src_assemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assemble_document(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    r"""SELECT doc_id, text FROM (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 4 = 0 THEN 'Page ' || doc_id || ' ' || text WHEN doc_id % 4 = 1 THEN doc_id::VARCHAR WHEN doc_id % 4 = 2 THEN substr(text, 1, 2) ELSE text END, '\s+', ' ', 'g')) AS text FROM documents)
    WHERE length(text) >= 3 AND NOT regexp_full_match(text, '\d+') AND NOT regexp_matches(text, '^(?i)(page|p\.)\s*\d+')"""
)
def flt_page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("doc_id") % 4, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" "), t)).when(k == 1, F.col("doc_id").cast("string")).when(k == 2, F.substring(t, 1, 2)).otherwise(t)
    return S.page_artifact_filter(table(spark, sf_dir, "documents").select("doc_id", made.alias("text")))


@query(
    r"""SELECT doc_id, text FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '. ', chr(10) || 'Page 3 of 9' || chr(10) || '12' || chr(10) || 'ab' || chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))),
    lambda l: length(l) >= 3 AND NOT regexp_full_match(l, '\d+') AND NOT regexp_matches(l, '^(?i)(page|p\.)\s*\d+')), ' ') AS text FROM documents) WHERE text <> ''"""
)
def flt_page_artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.replace(F.col("text"), F.lit(". "), F.lit("\nPage 3 of 9\n12\nab\n"))
    return S.page_artifact_filter(table(spark, sf_dir, "documents").select("doc_id", made.alias("text")), mode="line")


@query("SELECT doc_id, n_chars FROM documents WHERE trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END) <> ''")
def flt_drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text")))
    return S.drop_blank(docs).select("doc_id", "n_chars")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.txt' ELSE '.epub' END AS ext FROM pages WHERE page_id % 4 < 2")
def flt_supported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    path = F.concat(F.lit("books/"), F.col("page_id").cast("string"), F.when(k == 0, ".TXT").when(k == 1, ".epub").when(k == 2, ".doc").otherwise(""))
    return S.supported_sources(table(spark, sf_dir, "pages").withColumn("path", path))[0].select("page_id", S.suffix(F.col("path")).alias("ext"))


@query(f"SELECT doc_id, {CLEAN_SQL} AS text FROM {{NOISY}}")
def snk_write_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts written, one for each document, and read back."""
    folder = scratch_folder(spark, "clean")
    S.write_clean_text(derived(spark, sf_dir, NOISY).select("doc_id", T.universal_clean(F.col("text")).alias("text")), folder)
    return spark.read.schema("doc_id bigint, text string").parquet(folder)


@query(rf"SELECT source, count(*) AS docs, sum({_WORDS.format('text')})::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum({_WORDS.format('text')}) / 150.0::DOUBLE AS est_minutes, avg({_WORDS.format('text')}) AS avg_words FROM documents GROUP BY source")
def agg_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.text_stats(S.spread(table(spark, sf_dir, "documents")), "source")


def _hits_sql() -> str:
    expr, parts = "text", []
    for word, reading in T.SHORT_PRONUNCIATION:
        pattern = word.replace("'", "''")
        parts.append(rf"SELECT '{pattern}' AS word, coalesce(sum(len(regexp_extract_all(t{len(parts)}, '(?i)\b{pattern}\b'))), 0)::BIGINT AS hits FROM steps")
        expr = rf"regexp_replace({expr}, '\b{pattern}\b', '{reading}', 'gi')"
    cols, expr = ["text AS t0"], "text"
    for i, (word, reading) in enumerate(T.SHORT_PRONUNCIATION[:-1]):
        pattern = word.replace("'", "''")
        cols.append(rf"regexp_replace(t{i}, '\b{pattern}\b', '{reading}', 'gi') AS t{i + 1}")
    return f"WITH steps AS (SELECT {', '.join(cols)} FROM {{NOISY}}) " + " UNION ALL ".join(parts)


@query(_hits_sql())
def agg_dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.dictionary_hits(derived(spark, sf_dir, NOISY), T.SHORT_PRONUNCIATION)


# ---- packing: the same walk over tagged units as a recursive query ---------------------------------


def _walk(units: str, glue_fits: str, close: str = "false", fresh: str = "false") -> str:
    """units: doc_id, i, s, g, n (and more); one state row a unit."""
    return f"""WITH RECURSIVE u AS ({units}),
    w AS (SELECT doc_id, i, s AS now, n AS size, 1 AS c, {close.replace('NOW', 's')} AS ended FROM u WHERE i = 1
      UNION ALL SELECT u.doc_id, u.i,
        CASE WHEN w.ended OR {fresh} OR NOT ({glue_fits}) THEN u.s ELSE w.now || u.g || u.s END,
        CASE WHEN w.ended OR {fresh} OR NOT ({glue_fits}) THEN u.n ELSE w.size + u.n END,
        CASE WHEN w.ended OR {fresh} OR NOT ({glue_fits}) THEN w.c + 1 ELSE w.c END,
        {close.replace('NOW', f"(CASE WHEN w.ended OR {fresh} OR NOT ({glue_fits}) THEN u.s ELSE w.now || u.g || u.s END)").replace('ends', 'u.ends')}
      FROM w JOIN u ON u.doc_id = w.doc_id AND u.i = w.i + 1)
    SELECT doc_id, c AS NUMBER, arg_max(now, i) AS text FROM w GROUP BY doc_id, c"""


_NUMBERED = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, s, g, n, fresh, ends FROM ({}) WHERE s <> ''"
_SENTENCE_UNITS = rf"""SELECT doc_id, i, 1 AS j, trim(s) AS s, ' ' AS g, {_WORDS.format('s')} AS n, false AS fresh, false AS ends
  FROM (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS s, generate_subscripts({_SENTENCES.format('text')}, 1) AS i FROM {{SRC}})"""


_SPLIT_SQL = (
    _walk(
        f"SELECT v.*, (SELECT 1) FROM ({_NUMBERED.format(_SENTENCE_UNITS.replace('{SRC}', f'(SELECT doc_id, text FROM documents WHERE {_WORDS.format("text")} / 150.0 > 1.0)'))}) v".replace(", (SELECT 1)", ""),
        "w.size + u.n <= (SELECT 1.2 * t.target FROM t WHERE t.doc_id = u.doc_id)",
    )
    .replace("WITH RECURSIVE u AS", f"WITH RECURSIVE t AS (SELECT doc_id, floor({_WORDS.format('text')} / (greatest(2, floor({_WORDS.format('text')} / 150.0)::INT + 1)))::INT AS target, greatest(2, floor({_WORDS.format('text')} / 150.0)::INT + 1) AS want, len({_SENTENCES.format('text')}) AS have FROM documents), u AS")
    .replace("NUMBER", "section_no")
    .replace("FROM w GROUP BY", "FROM w JOIN t USING (doc_id) WHERE t.have >= t.want GROUP BY")
    + rf"""
    UNION ALL SELECT doc_id, 1, text FROM documents WHERE {_WORDS.format('text')} / 150.0 <= 1.0
    UNION ALL SELECT doc_id, k::INT + 1, array_to_string(ws[k * target + 1 : k * target + target], ' ') FROM
      (SELECT doc_id, target, ws, unnest(range(0, ceil(len(ws) / target)::INT)) AS k FROM (SELECT doc_id, target, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents JOIN t USING (doc_id) WHERE t.have < t.want AND {_WORDS.format('text')} / 150.0 > 1.0))"""
)


@query(_SPLIT_SQL)
def chk_split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return C.split_sections(docs, target_minutes=1)


_PARAGRAPH_SECTIONS = (
    _walk(
        _NUMBERED.format(rf"""SELECT doc_id, i, 1 AS j, trim(unnest(ps), ' ' || chr(10)) AS s, chr(10) || chr(10) AS g, unnest(list_transform(ps, lambda p: {_WORDS.format('p')})) AS n, false AS fresh, false AS ends, unnest(range(1, len(ps) + 1)) AS i
          FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS ps FROM {{PARAGRAPHS}})""".replace("i, 1 AS j", "1 AS j")),
        "w.size + u.n <= (SELECT 1.3 * t.target FROM t WHERE t.doc_id = u.doc_id)",
    )
    .replace("WITH RECURSIVE u AS", f"WITH RECURSIVE t AS (SELECT doc_id, greatest(2, floor({_WORDS.format('text')} / 150.0)::INT + 1) AS want, floor({_WORDS.format('text')} / (greatest(2, floor({_WORDS.format('text')} / 150.0)::INT + 1)))::INT AS target FROM {{PARAGRAPHS}}), u AS")
    .replace("NUMBER", "section_no")
)


@query(f"SELECT s.doc_id, s.section_no::INT AS section_no, s.text FROM ({_PARAGRAPH_SECTIONS}) s JOIN (SELECT doc_id, count(*) AS have FROM ({_PARAGRAPH_SECTIONS}) GROUP BY doc_id) h ON h.doc_id = s.doc_id JOIN (SELECT doc_id, greatest(2, floor({_WORDS.format('text')} / 150.0)::INT + 1) AS want, len(regexp_split_to_array(text, '\\n\\s*\\n')) AS paragraphs FROM {{PARAGRAPHS}}) w ON w.doc_id = s.doc_id WHERE have >= want * 0.8 AND paragraphs >= 2")
def chk_paragraph_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by paragraph alone, of texts that have blank lines."""
    t = F.col("text")
    n = F.greatest(F.lit(2), F.floor(T.word_count(t) / T.WORDS_PER_MINUTE).cast("int") + 1)
    parts = T.let(F.struct(t.alias("text"), n.alias("n"), T.word_count(t).alias("words")), lambda one: C.sections_by_paragraph(one["text"], F.floor(one["words"] / one["n"]).cast("int"), one["n"]))
    return C.exploded(derived(spark, sf_dir, PARAGRAPHS).select("doc_id", "text"), parts, "section_no")


_CHAR_UNITS = rf"""SELECT doc_id, i, 1 AS j, trim(s) AS s, ' ' AS g, length(trim(s)) AS n, false AS fresh, false AS ends FROM q WHERE length(trim(s)) <= 150
  UNION ALL SELECT doc_id, i, j, wd, ' ', length(wd), j = 1, false FROM (SELECT doc_id, i, unnest(ws) AS wd, generate_subscripts(ws, 1) AS j FROM (SELECT doc_id, i, list_filter(regexp_split_to_array(trim(s), '\s+'), lambda w: w <> '') AS ws FROM q WHERE length(trim(s)) > 150))"""
_Q = rf"q AS (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS s, generate_subscripts({_SENTENCES.format('text')}, 1) AS i FROM documents)"


_CHUNK_SQL = _walk(_NUMBERED.format(_CHAR_UNITS), "length(w.now) + 1 + u.n <= 150", fresh="u.fresh").replace("WITH RECURSIVE u AS", f"WITH RECURSIVE {_Q}, u AS").replace("NUMBER", "chunk_no")


@query(_CHUNK_SQL)
def chk_chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_sentences(S.spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))


def _paragraph_units(limit: int, source: str = "{PARAGRAPHS}") -> str:
    return rf"""WITH RECURSIVE p AS (SELECT doc_id, trim(unnest(ps)) AS para, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS ps FROM {source})),
    x AS (SELECT doc_id, i, 1 AS j, para AS s, chr(10) || chr(10) AS g, length(para) AS n, false AS fresh, true AS ends FROM p WHERE length(para) <= {limit}
      UNION ALL SELECT doc_id, i, unnest(generate_series(1, len(ss))), unnest(ss), ' ', unnest(list_transform(ss, lambda z: length(z))), false, false FROM (SELECT doc_id, i, {_SENTENCES.format('para')} AS ss FROM p WHERE length(para) > {limit})), u AS"""


@query(
    _walk(_NUMBERED.format("SELECT * FROM x"), "length(w.now) + length(u.g) + u.n <= 400").replace("WITH RECURSIVE u AS", _paragraph_units(400)).replace("NUMBER", "chunk_no")
    .replace("FROM w GROUP BY", "FROM w WHERE doc_id NOT IN (SELECT doc_id FROM {PARAGRAPHS} WHERE length(text) <= 400) GROUP BY")
    + " UNION ALL SELECT doc_id, 1, text FROM {PARAGRAPHS} WHERE length(text) <= 400"
)
def chk_chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_paragraphs(derived(spark, sf_dir, PARAGRAPHS).select("doc_id", "text"), max_chars=400)


@query(_walk(_NUMBERED.format("SELECT * FROM x"), "length(w.now) + length(u.g) + u.n <= 400", close="(ends AND length(NOW) >= 320)").replace("WITH RECURSIVE u AS", _paragraph_units(400)).replace("NUMBER", "chunk_no"))
def chk_chunk_paragraphs_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_paragraphs_eager(derived(spark, sf_dir, PARAGRAPHS).select("doc_id", "text"), max_chars=400)


# ---- the dialogue chunker as folds over strings: RS parts chunks, US marks one that waits ----------------


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _any_of(words: tuple[str, ...]) -> str:
    return "(" + "|".join(words) + ")"


_RS, _US = "chr(30)", "chr(31)"
_LIST = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_BARE = r"""regexp_replace(lower({}), '[.,!?";:]+$', '')"""
_CUT_MARKS = ((r"([.!?])\s+([A-Z\"])", r"\1' || chr(30) || '\2"), (r"(\.\")\s+([A-Z])", r"\1' || chr(30) || '\2"), (r"(\")\s+([A-Z][a-z])", r"\1' || chr(30) || '\2"), (r"(!\")\s+", r"\1' || chr(30) || '"), (r"(\?\")\s+", r"\1' || chr(30) || '"))


def _dialogue_sentences_sql(text: str) -> str:
    for pattern, kept in _CUT_MARKS:
        text = f"regexp_replace({text}, '{pattern}', '{kept}', 'g')"
    return f"list_filter(list_transform(string_split({text}, {_RS}), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"


def _safe_break_sql(a: str, b: str) -> str:
    last, first = _BARE.format("q.w[-1]"), "ltrim(lower(q.v[1]), '\"')"
    clean = _BARE.format("z.f")
    adjective = f"length(z.l) >= 3 AND (regexp_matches(z.l, '...{_any_of(B.ADJECTIVE_ENDINGS)}$') OR z.l IN {B.ADJECTIVES})"
    noun = f"(regexp_matches({clean}, '...{_any_of(B.NOUN_ENDINGS)}$') OR (length({clean}) >= 4 AND NOT regexp_matches({clean}, '(ly|ing|ed)$')))"
    starts, ends = sorted({c.split()[0] for c in B.COMPOUNDS}), sorted({c.split()[-1] for c in B.COMPOUNDS})
    rules = f"""CASE WHEN len(q.w) < 1 OR len(q.v) < 1 THEN true WHEN z.l IN {B.DETERMINERS} OR z.l IN {B.PREPOSITIONS} OR z.f IN {B.CONJUNCTIONS} OR ({adjective} AND {noun}) THEN false
      WHEN len(q.w) >= 2 AND regexp_matches(lower(q.w[-2] || ' ' || q.w[-1]), '^{_any_of(tuple(starts))}') AND regexp_matches(lower(q.w[-2] || ' ' || q.w[-1]), '{_any_of(tuple(ends))}$') THEN false
      WHEN q.a LIKE '%\"' OR q.a LIKE '%.' THEN true ELSE NOT contains(q.a, '\"') END"""
    return _let(f"struct_pack(a := trim({a}), w := {_LIST.format(a)}, v := {_LIST.format(b)})", "q", _let(f"struct_pack(l := {last}, f := {first})", "z", rules))


def _best_split_sql(a: str, limit: float) -> str:
    points = f"""CASE WHEN y.t LIKE '%.' THEN 2.0 WHEN y.t LIKE '%\"' THEN 1.5 WHEN regexp_matches(y.t, '[!?]$') THEN 1.0 ELSE 0 END - CASE WHEN y.l IN {B.ARTICLES} THEN 3.0 ELSE 0 END
      - CASE WHEN y.l IN {B.SHORT_PREPOSITIONS} THEN 2.0 ELSE 0 END - CASE WHEN y.f IN {B.SHORT_CONJUNCTIONS} THEN 1.5 ELSE 0 END - CASE WHEN length(y.t) < 30 THEN 1.0 ELSE 0 END"""
    one = _let(f"struct_pack(t := array_to_string(e[1 : i], ' '), l := {_BARE.format('e[i]')}, f := ltrim(lower(e[i + 1]), '\"'))", "y", f"CASE WHEN length(y.t) >= {limit * 0.6} THEN struct_pack(score := ({points})::DOUBLE, i := i) END")
    places = f"list_filter(list_transform(range(greatest(1, len(e) - 10) + 1, len(e)), lambda i: {one}), lambda y: y.score > -1)"
    return _let(_LIST.format(a), "e", f"CASE WHEN len(e) > 2 THEN list_max({places}).i END")


def _merge_sql(a: str, b: str) -> str:
    topics = " OR ".join(f"contains(substr(lower(trim({b})), 1, 50), '{x}')" for x in B.TOPIC_SHIFTS)
    return f"""CASE WHEN (trim({a}) LIKE '%\"') <> (trim({b}) LIKE '\"%') THEN true WHEN trim({a}) LIKE '%\"' AND trim({b}) LIKE '\"%' THEN false ELSE NOT ({topics}) END"""


_LAST = r"regexp_extract({}, '[^\x1e]*$')"


def _lines_sql(parts: str, limit: int) -> str:
    lay = f"CASE WHEN length({_LAST.format('p')}) + 1 + length(s) <= {limit} THEN p || ' ' || s ELSE p || {_RS} || s END"
    return f"coalesce(list_reduce(list_filter(list_transform({parts}, lambda s: trim(s)), lambda s: s <> ''), lambda p, s: {lay}), '')"


_CUTS_SQL = (r"[,;]\s+", r"\s+(?:and|but|or|however|meanwhile|then|while|when|as|because)\s+", r"\s+(?:after|before|during|since|until|while)\s+", r"\s+--\s+", r"\s+\(\s*")


def _dialogue_sql(text: str, limit: int) -> str:
    """A list of chunks."""
    cuts = " ".join(f"WHEN regexp_matches(c, '{cut}') THEN regexp_split_to_array(c, '{cut}')" for cut in _CUTS_SQL)
    cut_down = f"CASE WHEN length(c) <= {limit} THEN c ELSE {_lines_sql(f'CASE {cuts} ELSE ' + _LIST.format('c') + ' END', limit)} END"
    inner = _let(_best_split_sql("n", limit), "k", f"CASE WHEN k IS NOT NULL THEN {_let(_LIST.format('n'), 'd', f'array_to_string(d[1 : k], chr(32)) || {_RS} || array_to_string(d[k + 1 :], chr(32)) || chr(32) || x')} END")
    parted = f"CASE WHEN n = '' THEN x WHEN {_safe_break_sql('n', 'x')} THEN n || {_RS} || x ELSE coalesce({inner}, CASE WHEN length(n) > {limit * 0.8} THEN n || {_RS} || x ELSE n || ' ' || x END) END"
    settled = _let(parted, "r", _let(_LAST.format("r"), "c", f"left(r, length(r) - length(c)) || {cut_down}"))
    step = _let(_LAST.format("acc"), "n", f"left(acc, length(acc) - length(n)) || CASE WHEN length(n) + CASE WHEN n = '' THEN 0 ELSE 1 END + length(x) <= {limit} THEN n || CASE WHEN n = '' THEN '' ELSE ' ' END || x ELSE {settled} END")
    grown = f"list_filter(string_split(list_reduce({_dialogue_sentences_sql(text)}, lambda acc, x: {step}, ''), {_RS}), lambda o: true)"
    short = f"h || CASE WHEN length(h) < 40 THEN {_US} ELSE '' END"
    fits = lambda a, b: f"length({a}) + 1 + length({b}) <= {limit} AND {_merge_sql(a, b)}"
    waits = _let(f"rtrim({_LAST.format('m')}, {_US})", "b", f"CASE WHEN {fits('b', 'h')} THEN rtrim(m, {_US}) || ' ' || h ELSE rtrim(m, {_US}) || {_RS} || {short} END")
    merging = f"CASE WHEN m = '' THEN {short} WHEN ends_with(m, {_US}) THEN {waits} ELSE m || {_RS} || {short} END"
    together = f"list_reduce({grown}, lambda m, h: {merging}, '')"
    back = f"array_to_string(j[1 : len(j) - 2], {_RS}) || CASE WHEN len(j) > 2 THEN {_RS} ELSE '' END || j[-2] || ' ' || rtrim(j[-1], {_US})"
    ended = _let(f"string_split({together}, {_RS})", "j", f"CASE WHEN ends_with(j[-1], {_US}) AND len(j) > 1 AND length(rtrim(j[-1], {_US})) < 25 AND {fits('j[-2]', f'rtrim(j[-1], {_US})')} THEN {back} ELSE rtrim(array_to_string(j, {_RS}), {_US}) END")
    clean = f"list_filter(list_transform(string_split({ended}, {_RS}), lambda g: trim(g)), lambda g: g <> '')"
    return f"flatten(list_transform({clean}, lambda g: CASE WHEN length(g) <= {limit} THEN [g] ELSE string_split({_lines_sql(_LIST.format('g'), limit)}, {_RS}) END))"


_SPACED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SAID = """CASE WHEN turn % 2 = 1 THEN '"' || text || '" said' ELSE text END"""


@query(f"SELECT conv_id, turn, unnest(range(1, len(chunks) + 1))::INT AS chunk_no, unnest(chunks) AS text FROM (SELECT conv_id, turn, {_dialogue_sql('text', 249)} AS chunks FROM (SELECT conv_id, turn, {_SPACED.format(_SAID)} AS text FROM conversations))")
def chk_chunk_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('"'), F.col("text"), F.lit('" said'))).otherwise(F.col("text"))
    return C.chunk_dialogue(turns.select("conv_id", "turn", said.alias("text")))


#: Documents with speech put in, for the rules about quotation marks.
_SPOKEN = """SELECT doc_id, replace(replace(text, '. T', '." "T'), ' the ', CASE WHEN doc_id % 3 = 0 THEN ', said the ' ELSE ' the ' END) AS text FROM documents"""


@query(f"SELECT doc_id, unnest(range(1, len(chunks) + 1))::INT AS chunk_no, unnest(chunks) AS text FROM (SELECT doc_id, {_dialogue_sql('text', 249)} AS chunks FROM (SELECT doc_id, {_SPACED.format('text')} AS text FROM ({_SPOKEN})))")
def chk_chunk_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogue chunker on long texts."""
    return C.chunk_dialogue(S.spread(derived(spark, sf_dir, _SPOKEN)))


def _chunked_sql(k: int, walk: str) -> str:
    return f"SELECT doc_id, chunk_no::INT AS chunk_no, text FROM ({walk.replace('FROM documents', f'FROM (SELECT doc_id, text FROM documents WHERE doc_id % 4 = {k})').replace('{SOME}', f'(SELECT doc_id, text FROM documents WHERE doc_id % 4 = {k})')})"


_WITH_SQL = " UNION ALL ".join((
    _chunked_sql(0, f"SELECT doc_id, unnest(range(1, len(chunks) + 1)) AS chunk_no, unnest(chunks) AS text FROM (SELECT doc_id, {_dialogue_sql('text', 200)} AS chunks FROM (SELECT doc_id, {_SPACED.format('text')} AS text FROM documents))"),
    _chunked_sql(1, _walk(_NUMBERED.format("SELECT * FROM x"), "length(w.now) + length(u.g) + u.n <= 200").replace("WITH RECURSIVE u AS", _paragraph_units(200, "{SOME}")).replace("NUMBER", "chunk_no").replace("FROM w GROUP BY", "FROM w WHERE doc_id NOT IN (SELECT doc_id FROM {SOME} WHERE length(text) <= 200) GROUP BY") + " UNION ALL SELECT doc_id, 1, text FROM {SOME} WHERE length(text) <= 200"),
    _chunked_sql(2, _walk(_NUMBERED.format("SELECT * FROM x"), "length(w.now) + length(u.g) + u.n <= 200", close="(ends AND length(NOW) >= 160)").replace("WITH RECURSIVE u AS", _paragraph_units(200, "{SOME}")).replace("NUMBER", "chunk_no")),
    _chunked_sql(3, _walk(_NUMBERED.format(_CHAR_UNITS), "length(w.now) + 1 + u.n <= 150", fresh="u.fresh").replace("WITH RECURSIVE u AS", f"WITH RECURSIVE {_Q}, u AS").replace("150", "200").replace("NUMBER", "chunk_no")),
))


@query(_WITH_SQL)
def chk_chunk_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies by row."""
    docs = S.spread(table(spark, sf_dir, "documents")).select("doc_id", "text", F.element_at(F.array(*map(F.lit, C.available())), (F.col("doc_id") % 4 + 1).cast("int")).alias("strategy"))
    return C.chunk_with(docs, "strategy", max_chars=200).drop("strategy")


_ENDS = "('" + "|".join(B.ADJECTIVE_ENDINGS) + "')"


@query(
    rf"""WITH s AS (SELECT doc_id, unnest(ss) AS a, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, list_filter(list_transform({_SENTENCES.format('text')}, lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)),
    p AS (SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s),
    w AS (SELECT doc_id, i, a, b, regexp_replace(lower(list_extract(list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> ''), -1)), '[.,!?";:]+$', '') AS l, ltrim(lower(list_extract(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> ''), 1)), '"') AS f FROM p WHERE b IS NOT NULL)
    SELECT doc_id, i::INT AS sentence_no, (CASE WHEN a LIKE '%.' THEN 2.0 ELSE 0 END + CASE WHEN a LIKE '%"' THEN 1.5 ELSE 0 END + CASE WHEN a LIKE '%!' OR a LIKE '%?' THEN 1.0 ELSE 0 END
      - CASE WHEN l IN {B.ARTICLES} THEN 3.0 ELSE 0 END - CASE WHEN l IN {B.SHORT_PREPOSITIONS} THEN 2.0 ELSE 0 END - CASE WHEN f IN {B.SHORT_CONJUNCTIONS} THEN 1.5 ELSE 0 END - CASE WHEN length(a) < 30 THEN 1.0 ELSE 0 END)::DOUBLE AS score,
      CASE WHEN (a LIKE '%"') <> (b LIKE '"%') THEN true WHEN a LIKE '%"' AND b LIKE '"%' THEN false ELSE NOT ({' OR '.join(f"contains(substr(lower(b), 1, 50), '{x}')" for x in B.TOPIC_SHIFTS)}) END AS merge_ok,
      (CASE WHEN a LIKE '%"' OR a LIKE '"%' OR contains(lower(right(a, 20)), 'said') OR contains(lower(right(a, 20)), 'replied') THEN 0.3
        WHEN a LIKE '%.' AND (b LIKE '"%' OR upper(b[1]) <> lower(b[1]) AND b[1] = upper(b[1])) AND ({' OR '.join(f"contains(lower(substr(b, 1, 50)), '{x}')" for x in B.TIME_SHIFTS)}) THEN 0.55
        WHEN contains(a, '--') OR a LIKE '%...' OR a LIKE '%!' OR a LIKE '%?' THEN 0.55 WHEN a LIKE '%.' THEN 0.4 ELSE 0.3 END)::DOUBLE AS gap_s FROM w"""
)
def scr_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C._stripped(T.split_sentences(F.col("text")))
    p = C.exploded_pairs(S.spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), parts, "sentence_no", following="b")
    a, b = F.col("text"), F.col("b")
    return p.select("doc_id", "sentence_no", B.split_score(a, b).alias("score"), B.is_safe_merge(a, b).alias("merge_ok"), B.gap_after(a, b).alias("gap_s"))


@query(
    f"""SELECT doc_id, i::INT AS sentence_no, {_safe_break_sql('a', 'b')} AS break_ok, {_best_split_sql('a', 60)}::INT AS best_words FROM (SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM
    (SELECT doc_id, unnest(ss) AS a, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, {_dialogue_sentences_sql('text')} AS ss FROM documents))) WHERE b IS NOT NULL"""
)
def scr_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a chunk may end between sentences, and the best cut within."""
    parts = C._stripped(T.split_dialogue_sentences(F.col("text")))
    p = C.exploded_pairs(S.spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), parts, "sentence_no", following="b")
    return p.select("doc_id", "sentence_no", B.is_safe_break(F.col("text"), F.col("b")).alias("break_ok"), B.best_split(F.col("text"), F.col("b"), 60).alias("best_words"))


_WORDLIKE = r"""SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word FROM documents"""


@query(
    f"""SELECT word, length(c) >= 3 AND (regexp_matches(c, '...{_any_of(B.ADJECTIVE_ENDINGS)}$') OR c IN {B.ADJECTIVES}) AS adjective,
    (regexp_matches(word, '^\\p{{Lu}}') AND length(d) > 2) OR regexp_matches(d, '...{_any_of(B.NOUN_ENDINGS)}$') OR (length(d) >= 4 AND NOT regexp_matches(d, '(ly|ing|ed)$')) AS noun
    FROM (SELECT DISTINCT word, {_BARE.format('word')} AS c, {_BARE.format("ltrim(word, chr(34))")} AS d FROM ({_WORDLIKE}))"""
)
def str_word_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words look like adjectives, and which like nouns."""
    words = S.spread(table(spark, sf_dir, "documents")).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", B.is_adjective_like(F.col("word")).alias("adjective"), B.is_noun_like(F.col("word")).alias("noun"))


_PRICES = "SELECT DISTINCT source AS model, CAST(CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 30.0 WHEN CAST(substr(source, 4) AS INT) % 3 = 1 THEN 0.6 END AS DOUBLE) AS usd_per_million FROM documents"


@query(f"SELECT source AS model, sum(length(text))::BIGINT AS chars, sum(length(text) / 1e6 * coalesce(usd_per_million, 15.0)) AS usd, sum(length(text) / 1e6 * coalesce(usd_per_million, 15.0)) > 1.0 AS warn FROM documents LEFT JOIN ({_PRICES}) p ON p.model = source GROUP BY source")
def agg_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = derived(spark, sf_dir, _PRICES).filter("usd_per_million is not null")
    return jobs.cost_summary(joins.price_join(table(spark, sf_dir, "documents").withColumnRenamed("source", "model"), prices), "model")


def narration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned, sectioned and chunked; chunks, characters, minutes and cost by language."""
    docs = S.spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", T.universal_clean(F.col("text")).alias("text"))
    chunks = C.chunk_sentences(C.split_sections(docs, target_minutes=1))
    priced = joins.price_join(chunks.withColumnRenamed("source", "model"), derived(spark, sf_dir, _PRICES).filter("usd_per_million is not null"))
    return priced.groupBy("lang").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), (F.sum(T.word_count(F.col("text"))) / T.WORDS_PER_MINUTE).alias("minutes"), F.sum(F.length("text") / 1e6 * F.col("usd_per_million")).alias("usd")
    )


_FLAGSHIP_SQL = f"""WITH clean AS (SELECT doc_id, lang, source, {CLEAN_SQL} AS text FROM documents),
  sections AS (SELECT doc_id * 100000 + section_no AS doc_id, text FROM ({_SPLIT_SQL.replace("FROM documents", "FROM clean")})),
  chunks AS ({_CHUNK_SQL.replace("FROM documents", "FROM sections")})
  SELECT d.lang, count(*) AS chunks, sum(length(c.text))::BIGINT AS chars, sum({_WORDS.format("c.text")}) / 150.0::DOUBLE AS minutes, sum(length(c.text) / 1e6 * coalesce(p.usd_per_million, 15.0)) AS usd
  FROM chunks c JOIN clean d ON d.doc_id = c.doc_id // 100000 LEFT JOIN ({_PRICES}) p ON p.model = d.source GROUP BY d.lang"""


@query(_FLAGSHIP_SQL)
def flagship_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration_plan(spark, sf_dir)
