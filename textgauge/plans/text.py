"""Text preparation and feature profiles over the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import profiles, shaping, text
from .fixtures import (PROBLEMS_SQL, REQUESTS_SQL, problems, requests, rounded, table, texts)

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Words that do occur in the given prose, so the counts are not all zero.
PROSE_WORDS = {
    "graph_algorithms": ["the", "of", "which", "this"],
    "dynamic_programming": ["la", "est", "une"],
    "data_structures": ["der", "und", "die", "of the"],
    "sorting_searching": ["de", "los", "que"],
    "string_processing": ["and", "er", "in the"],
}
PROSE_TIERS = {
    "ultra_hard_score": (5.0, ["of the", "in the"]),
    "hard_score": (4.0, ["de la", "est"]),
    "medium_hard_score": (3.0, ["der", "die", "und"]),
    "medium_score": (2.0, ["que", "los"]),
    "basic_score": (1.0, ["the", "of", "and"]),
}
PROSE_LISTS = {name: words for name, words in zip(lx.WIDE_WORDS, [
    ["the", "was"], ["of", "is"], ["and", "by"], ["to", "for"], ["en", "es"], ["la", "le"],
    ["der", "das"], ["that", "wh.?ch"],
])}
PROSE_EXPANSIONS = {"the": "the one and only", "es": "es ist", "ou": "ou bien"}


def flat_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{SPACE_SQL}+', ' ', 'g'))"


def marked_sql(c: str, word: str = r"[\p{L}\p{N}_]") -> str:
    return f"regexp_replace({c}, '({word}+)', '⟦\\1⟧', 'g')"


def marked_word(phrase: str) -> str:
    return " ".join(f"⟦{w}⟧" for w in phrase.split(" "))


def listed_sql(m: str, words) -> str:
    """Standing-alone matches in marked text; only plain words and wh.?ch-like ones are used."""
    alternation = "|".join(marked_word(w) for w in words)
    return f"len(regexp_extract_all({m}, '{alternation}'))"


def count_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def expand_sql(flat: str, expansions: dict) -> str:
    c = marked_sql(flat)
    for short, long in expansions.items():
        c = f"replace({c}, '⟦{short}⟧', '{marked_word(long)}')"
    return f"replace(replace({c}, '⟦', ''), '⟧', '')"


def spans_sql(c: str, spans) -> str:
    return count_sql(c, "|".join(".*".join(s) for s in spans))


def lexical_sql(words: str) -> dict[str, str]:
    n = f"len({words})"
    return {
        "word_count": n,
        "vocabulary_richness":
            f"coalesce(round(len(list_distinct({words})) / nullif({n}, 0), 6), 0.0)",
        "avg_word_length":
            f"coalesce(round(len(array_to_string({words}, '')) / nullif({n}, 0), 6), 0.0)",
    }


def core_sql(source: str, key: str, column: str, words: dict, expansions: dict | None = None,
             ) -> str:
    norm = expand_sql(flat_sql(column), expansions) if expansions else flat_sql(column)
    w = lexical_sql("w")
    listed = ", ".join(f"{listed_sql('m', terms)} AS {name}" for name, terms in words.items())
    return f"""
  WITH n AS (SELECT {key}, {norm} AS t FROM ({source}) s),
  p AS (SELECT {key}, t, {marked_sql('t')} AS m,
               CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM n)
  SELECT {key}, length(t) AS text_len, {w['word_count']} AS word_count, {listed},
         {count_sql('t', lx.BASIC_MATH)} AS basic_math,
         {count_sql('t', lx.ADVANCED_MATH)} AS advanced_math,
         {count_sql('t', lx.BIG_O)} AS complexity_notation,
         {count_sql('t', lx.CONSTRAINTS)} AS constraints,
         {count_sql('t', lx.OPTIMIZATION)} AS optimization,
         {spans_sql('t', lx.MULTIPLE_CASES)} AS multiple_cases,
         {w['vocabulary_richness']} AS vocabulary_richness,
         {w['avg_word_length']} AS avg_word_length
  FROM p"""


def wide_sql(source: str, key: str, column: str, tiers: dict, words: dict, literal: bool = False,
             ) -> str:
    norm = expand_sql(flat_sql(column), lx.FULL_EXPANSIONS)
    if literal:
        return literal_sql(source, key, column, tiers, words)
    w = lexical_sql("w")
    tier = {name: "(" + " + ".join(listed_sql("m", [t]) for t in terms) + f") * {weight}"
            for name, (weight, terms) in tiers.items()}
    lists = ", ".join(f"{listed_sql('m', terms)} AS {name}" for name, terms in words.items())
    competitive = [t for t in lx.COMPETITIVE_TERMS if ".*" not in t]
    loose = [t for t in lx.COMPETITIVE_TERMS if ".*" in t]
    comp = "|".join([marked_word(t) for t in competitive] + [f"⟦{t}⟧" for t in loose])
    names = ", ".join(profiles.wide_names(tiers, words))
    return f"""
  WITH n AS (SELECT {key}, {norm} AS t FROM ({source}) s),
  p AS (SELECT {key}, t, {marked_sql('t')} AS m,
               CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM n),
  a AS (SELECT {key}, length(t) AS text_len,
         {', '.join(f'{e} AS {n}' for n, e in w.items())},
         {', '.join(f'{e} AS {n}' for n, e in tier.items())},
         {count_sql('t', lx.WIDE_MATH)} AS advanced_math_symbols,
         {listed_sql('m', lx.MATH_FUNCTIONS)} AS mathematical_functions,
         {count_sql('t', lx.BIG_O)} * 3.0 AS big_o_notation,
         {spans_sql('t', lx.TIME_MENTIONS)} * 4.0 AS time_complexity_mentions,
         {spans_sql('t', lx.SPACE_MENTIONS)} * 3.0 AS space_complexity_mentions,
         {count_sql('t', lx.CONSTRAINT_MENTIONS)} * 2.0 AS constraint_patterns,
         {lists},
         len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: trim(s) <> ''))
           AS sentence_count,
         {spans_sql('t', lx.IO_FORMAT)} * 1.5 + {spans_sql('t', lx.IO_CASES)} * 1.0
           + {count_sql('t', lx.IO_SAMPLES)} * 0.5 AS io_complexity,
         {count_sql('m', comp)} AS competitive_terms
       FROM p),
  b AS (SELECT *, {' + '.join(tiers)} AS total_algorithm_score,
         advanced_math_symbols * 3.0 + mathematical_functions * 2.0 + big_o_notation
           AS math_complexity_score,
         time_complexity_mentions + space_complexity_mentions + constraint_patterns
           AS complexity_score,
         coalesce(round(word_count / nullif(sentence_count, 0), 6), 0.0) AS avg_sentence_length
       FROM a)
  SELECT {key}, {names} FROM b"""


def literal_sql(source: str, key: str, column: str, tiers: dict, words: dict) -> str:
    """The 30 features as written with doubled backslashes: no bounded word ever matches."""
    w = lexical_sql("w")
    zeros = ", ".join(f"0.0 AS {n}" for n in [*tiers, *words, "mathematical_functions", "big_o_notation",
                                              "total_algorithm_score", "competitive_terms"])
    return f"""
  WITH n AS (SELECT {key}, regexp_replace(lower(coalesce({column}, '')),
               '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS t, {flat_sql(column)} AS f FROM ({source}) s),
  p AS (SELECT {key}, t, CASE WHEN f = '' THEN [] ELSE string_split(f, ' ') END AS w FROM n),
  a AS (SELECT {key}, length(t) AS text_len, {', '.join(f'{e} AS {n}' for n, e in w.items())}, {zeros},
         {count_sql('t', lx.WIDE_MATH)} AS advanced_math_symbols,
         {spans_sql('t', lx.TIME_MENTIONS)} * 4.0 AS time_complexity_mentions,
         {spans_sql('t', lx.SPACE_MENTIONS)} * 3.0 AS space_complexity_mentions,
         {count_sql('t', 'constraint|limit|bound')} * 2.0 AS constraint_patterns,
         len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: regexp_replace(s, '{SPACE_SQL}+', '', 'g') <> ''))
           AS sentence_count,
         {spans_sql('t', lx.IO_FORMAT)} * 1.5 + {spans_sql('t', lx.IO_CASES)} * 1.0
           + {count_sql('t', lx.IO_SAMPLES)} * 0.5 AS io_complexity FROM p),
  b AS (SELECT *, advanced_math_symbols * 3.0 AS math_complexity_score,
         time_complexity_mentions + space_complexity_mentions + constraint_patterns AS complexity_score,
         coalesce(round(word_count / nullif(sentence_count, 0), 6), 0.0) AS avg_sentence_length FROM a)
  SELECT {key}, {', '.join(profiles.wide_names(tiers, words))} FROM b"""


def doubles(df, names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def cast_sql(sql: str, key: str, names) -> str:
    """All features as DOUBLE, so both engines hash one type."""
    return f"SELECT {key}, " + ", ".join(
        f"CAST({n} AS DOUBLE) AS {n}" for n in names) + f" FROM ({sql}) q"


RATIOS = ["vocabulary_richness", "avg_word_length"]


def core(words=None, source=texts, column="text", key="doc_id", name="documents", expansions=None):
    def run(spark, sf):
        df = texts(spark, sf, name).select(key, column)
        out = profiles.core_profile(df, column, words, expansions).drop(column)
        return doubles(rounded(out, *RATIOS), profiles.CORE_FEATURES)
    return run


def wide(tiers=None, words=None, literal=False):
    def run(spark, sf):
        df = texts(spark, sf).select("doc_id", "text")
        out = profiles.wide_profile(df, "text", tiers, words, literal).drop("text")
        out = rounded(out, *RATIOS, "avg_sentence_length")
        return doubles(out, [c for c in out.columns if c != "doc_id"])
    return run


def core_by_language(spark, sf):
    """Flagship: the 15 features of every document, averaged per language and class."""
    docs = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    cls = (F.when(F.col("toxic") == 1, "hard").when(F.col("quality") == 1, "easy")
           .when(F.col("quality").isNotNull(), "medium").otherwise("none"))
    df = profiles.core_profile(docs.select("lang", cls.alias("problem_class"), "text"), "text",
                               PROSE_WORDS)
    return df.groupBy("lang", "problem_class").agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in profiles.CORE_FEATURES])


CORE_BY_LANGUAGE_SQL = f"""
  WITH f AS ({core_sql("SELECT doc_id, text FROM documents", "doc_id", "text", PROSE_WORDS)
             .replace("WITH n AS", "WITH n AS", 1)}),
  c AS (SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'hard' WHEN l.quality = 1 THEN 'easy'
          WHEN l.quality IS NOT NULL THEN 'medium' ELSE 'none' END AS problem_class
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  SELECT lang, problem_class, count(*) AS n,
    {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in profiles.CORE_FEATURES)}
  FROM f JOIN c USING (doc_id) GROUP BY 1, 2"""


def rename_fields(spark, sf):
    raw = texts(spark, sf).select("doc_id", F.col("lang").alias("input_description"),
                                  F.col("source").alias("output_description"))
    return raw.withColumnsRenamed({"input_description": "input_desc",
                                   "output_description": "output_desc"})


def combined(spark, sf):
    r = requests(spark, sf)
    c = text.combine(F.col("description"), F.col("input_desc"), F.col("output_desc"))
    return r.select("request_id", c.alias("c")).select(
        "request_id", F.length("c").cast("bigint").alias("length"), F.md5("c").alias("digest"),
        text.cache_key(F.col("c")).alias("cache_key"))


STRIP_SQL = (f"regexp_replace(concat(coalesce(description,''),' ',coalesce(input_desc,''),' ',"
             f"coalesce(output_desc,'')), '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')")


def normalised(spark, sf):
    df = texts(spark, sf).select(
        "doc_id", text.flatten(F.col("text")).alias("t"),
        text.normalise(F.col("text"), PROSE_EXPANSIONS).alias("e"),
        text.normalise(F.col("text"), lx.FULL_EXPANSIONS).alias("f"))
    words = text.tokens(F.col("t"))
    return df.select("doc_id", F.md5("t").alias("plain"), F.md5("e").alias("expanded"),
                     F.md5("f").alias("full_expansion"),
                     F.size(words).cast("bigint").alias("n_tokens"),
                     F.md5(F.array_join(words, "|")).alias("tokens"))


NORMALISED_SQL = f"""
  WITH n AS (SELECT doc_id, {flat_sql('text')} AS t FROM documents)
  SELECT doc_id, md5(t) AS plain, md5({expand_sql('t', PROSE_EXPANSIONS)}) AS expanded,
         md5({expand_sql('t', lx.FULL_EXPANSIONS)}) AS full_expansion,
         CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_tokens,
         md5(replace(t, ' ', '|')) AS tokens FROM n"""


def preview(words=None):
    def run(spark, sf):
        df = texts(spark, sf).select("doc_id", "text")
        return rounded(profiles.preview_profile(df, "text", words).drop("text"),
                       "lexical_diversity")
    return run


def preview_sql(words) -> str:
    ascii_word = "[A-Za-z0-9_]"
    symbols = lx.PREVIEW_SYMBOLS
    return f"""
  WITH p AS (SELECT doc_id, text, {marked_sql('lower(text)', ascii_word)} AS m FROM documents),
  q AS (SELECT *, regexp_extract_all(m, '⟦([a-z]{{2,}})⟧', 1) AS w FROM p)
  SELECT doc_id, length(text) AS length, {count_sql('text', symbols)} AS math_symbols,
         {listed_sql('m', words)} AS keywords,
         coalesce(round(len(list_distinct(w)) / nullif(len(w), 0), 6), 0.0) AS lexical_diversity
  FROM q"""


def score_fields(spark, sf):
    """Clamp, round, reliability, band, and the fields of a structured answer."""
    p = problems(spark, sf)
    raw = (F.col("problem_score") * 1.7 - 2.0).alias("raw")
    conf = ((F.col("problem_id") * 37 % 1000) / 1000.0).alias("conf")
    d = p.select("*", raw, conf)
    extras = shaping.input_extras(F.col("description"), F.col("input_desc"),
                                  F.coalesce("output_desc", F.lit("")))
    d = d.select("problem_id", shaping.served_score(F.col("raw")).alias("score"),
                 shaping.served_confidence(F.col("conf")).alias("confidence"),
                 shaping.is_reliable(F.col("conf")).alias("reliable"),
                 shaping.score_band(F.col("raw")).alias("band"),
                 (shaping.score_band(F.col("raw")) != F.col("problem_class")).alias("band_differs"),
                 F.col("problem_score").alias("problem_score_scaled"), extras.alias("x"))
    return d.select("*", "x.format", F.col("x.description_length").cast("bigint").alias("dl"),
                    F.col("x.input_desc_length").cast("bigint").alias("il"),
                    F.col("x.output_desc_length").cast("bigint").alias("ol")).drop("x")


SCORE_FIELDS_SQL = f"""
  WITH p AS (SELECT *, problem_score * 1.7 - 2.0 AS raw, (problem_id * 37 % 1000) / 1000.0 AS conf
             FROM ({PROBLEMS_SQL}) x),
  b AS (SELECT *, CASE WHEN raw < 4 THEN 'easy' WHEN raw < 7 THEN 'medium' ELSE 'hard' END AS band
        FROM p)
  SELECT problem_id, round(greatest(1.0, least(10.0, raw)), 1) AS score,
         CAST(round(conf, 3) AS DOUBLE) AS confidence, conf > 0.55 AS reliable, band,
         band <> problem_class AS band_differs, problem_score AS problem_score_scaled,
         'structured' AS format, length(description) AS dl, length(input_desc) AS il,
         length(coalesce(output_desc, '')) AS ol FROM b"""


def feature_answer(spark, sf):
    """The ten-field answer struct as JSON-free columns."""
    df = profiles.core_profile(texts(spark, sf).select("doc_id", "text"), "text", PROSE_WORDS)
    s = df.select("doc_id", shaping.feature_struct().alias("features"))
    return s.select("doc_id", "features.*").withColumns({
        c: F.col(c).cast("double") for c in s.schema["features"].dataType.fieldNames()})


FEATURE_ANSWER_SQL = f"""
  SELECT doc_id, CAST(text_len AS DOUBLE) AS "textLength", CAST(word_count AS DOUBLE) AS "wordCount",
    CAST(graph_algorithms AS DOUBLE) AS "graphAlgorithms",
    CAST(dynamic_programming AS DOUBLE) AS "dynamicProgramming",
    CAST(data_structures AS DOUBLE) AS "dataStructures",
    CAST(sorting_searching AS DOUBLE) AS "sortingSearching",
    CAST(string_processing AS DOUBLE) AS "stringProcessing",
    CAST(basic_math AS DOUBLE) AS "basicMath", CAST(advanced_math AS DOUBLE) AS "advancedMath",
    CAST(complexity_notation AS DOUBLE) AS "complexityNotation"
  FROM ({core_sql("SELECT doc_id, text FROM documents", "doc_id", "text", PROSE_WORDS)}) q"""

_DOCS = "SELECT doc_id, text FROM documents"
_PAGES = "SELECT page_id, html FROM pages"
PAGE_EXPANSIONS = {"div": "division element", "li": "list item", "http": "hyper text"}

QUERIES = {
    "core_features_by_language": (core_by_language, CORE_BY_LANGUAGE_SQL),
    "src_rename_fields": (
        rename_fields,
        "SELECT doc_id, lang AS input_desc, source AS output_desc FROM documents"),
    "prj_combine_and_key": (
        combined,
        f"SELECT request_id, length(c) AS length, md5(c) AS digest, md5(c) AS cache_key FROM "
        f"(SELECT request_id, {STRIP_SQL} AS c FROM ({REQUESTS_SQL}) r) q"),
    "prj_normalise_expand_tokens": (normalised, NORMALISED_SQL),
    "prj_score_fields": (score_fields, SCORE_FIELDS_SQL),
    "prj_feature_answer": (feature_answer, FEATURE_ANSWER_SQL),
    "f15_documents": (
        core(), cast_sql(core_sql(_DOCS, "doc_id", "text", lx.CORE_WORDS, lx.SHORT_EXPANSIONS),
                         "doc_id", profiles.CORE_FEATURES)),
    "f15_documents_prose_lexicon": (
        core(PROSE_WORDS, expansions=PROSE_EXPANSIONS),
        cast_sql(core_sql(_DOCS, "doc_id", "text", PROSE_WORDS, PROSE_EXPANSIONS), "doc_id",
                 profiles.CORE_FEATURES)),
    "f15_pages": (
        core(PROSE_WORDS, column="html", key="page_id", name="pages", expansions=PAGE_EXPANSIONS),
        cast_sql(core_sql(_PAGES, "page_id", "html", PROSE_WORDS, PAGE_EXPANSIONS), "page_id",
                 profiles.CORE_FEATURES)),
    "f30_documents": (
        wide(), cast_sql(wide_sql(_DOCS, "doc_id", "text", lx.TIERS, {
            k: v for k, v in lx.WIDE_WORDS.items()}), "doc_id", profiles.WIDE_FEATURES)),
    "f30_documents_literal": (
        wide(literal=True), cast_sql(wide_sql(_DOCS, "doc_id", "text", lx.TIERS, lx.WIDE_WORDS, True),
                                     "doc_id", profiles.WIDE_FEATURES)),
    "f30_documents_prose_lexicon": (
        wide(PROSE_TIERS, PROSE_LISTS),
        cast_sql(wide_sql(_DOCS, "doc_id", "text", PROSE_TIERS, PROSE_LISTS), "doc_id",
                 profiles.WIDE_FEATURES)),
    "ui_preview": (preview(), preview_sql(lx.PREVIEW_WORDS)),
    "ui_preview_prose_lexicon": (
        preview(["the", "of", "und", "est"]), preview_sql(["the", "of", "und", "est"])),
}
