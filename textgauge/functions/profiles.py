"""The 15-, 30- and 4-feature text profiles: plain projections, no Python on the data path."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import (
    SPACE, beyond_ascii, bounded, count, count_listed, count_spans, count_standing, expand, flatten,
    is_blank, mark_words, tokens,
)

CORE_FEATURES = [
    "text_len", "word_count", *lx.CORE_WORDS, "basic_math", "advanced_math",
    "complexity_notation", "constraints", "optimization", "multiple_cases",
    "vocabulary_richness", "avg_word_length",
]


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _lexical(words: Column, text: Column) -> dict[str, Column]:
    """Word count, distinct share and mean word length of a token array.

    The token lengths add up to the text length less its single spaces, so no fold is needed.
    """
    n = F.size(words).cast("bigint")
    letters = F.length(text).cast("bigint") - F.greatest(n - 1, _zero())
    return {
        "word_count": n,
        "vocabulary_richness": F.coalesce(
            F.try_divide(F.size(F.array_distinct(words)), n), F.lit(0.0)
        ),
        "avg_word_length": F.coalesce(F.try_divide(letters, n), F.lit(0.0)),
    }


def _prepared(df: DataFrame, text: str, expansions: Mapping[str, str]) -> DataFrame:
    """Add _norm (normalised text), _marked (its words marked) and _words (its tokens).

    Each is its own projection and used many times, so Catalyst keeps them apart and computes them
    once per row. Texts without any of the abbreviations skip the expansion passes.
    """
    flat = df.withColumn("_flat", flatten(F.col(text)))
    t = F.col("_flat")
    if expansions:
        some = F.lit(False)
        for short in expansions:
            some = some | F.contains(t, F.lit(short))
        here = F.regexp_like(t, F.lit(bounded(expansions)))
        t = F.when(some & here, expand(t, expansions)).otherwise(t)
    return flat.withColumn("_norm", t).drop("_flat").withColumns(
        {"_marked": mark_words(F.col("_norm")), "_words": tokens(F.col("_norm"))})


def core_profile(
    df: DataFrame, text: str, words: Mapping[str, Sequence[str]] | None = None,
    expansions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Append the 15 features of `text`; NULL or empty text gives zeros."""
    words = lx.CORE_WORDS if words is None else words
    expansions = lx.SHORT_EXPANSIONS if expansions is None else expansions
    base = _prepared(df, text, expansions)
    t = F.col("_norm")
    lex = _lexical(F.col("_words"), t)
    cols = {"text_len": F.length(t).cast("bigint"), "word_count": lex["word_count"]}
    for name, terms in words.items():
        cols[name] = count_listed(t, F.col("_marked"), terms)
    cols["basic_math"] = count(t, lx.BASIC_MATH)
    cols["advanced_math"] = count(t, beyond_ascii(lx.ADVANCED_MATH))
    cols["complexity_notation"] = count(t, lx.BIG_O, "o(")
    cols["constraints"] = count(t, lx.CONSTRAINTS, "constraint", "limit", "≤")
    cols["optimization"] = count(t, lx.OPTIMIZATION, *lx.OPTIMIZATION.split("|"))
    cols["multiple_cases"] = count_spans(t, lx.MULTIPLE_CASES)
    cols["vocabulary_richness"] = lex["vocabulary_richness"]
    cols["avg_word_length"] = lex["avg_word_length"]
    return base.withColumns(cols).drop("_norm", "_marked", "_words")


def wide_names(tiers: Iterable[str], words: Iterable[str]) -> list[str]:
    """Output order of the 30-feature profile for the given tier and list names."""
    return [
        "text_len", "word_count", "total_algorithm_score", *tiers, "math_complexity_score",
        "advanced_math_symbols", "mathematical_functions", "big_o_notation", "complexity_score",
        "time_complexity_mentions", "space_complexity_mentions", "constraint_patterns", *words,
        "sentence_count", "vocabulary_richness", "avg_word_length", "avg_sentence_length",
        "io_complexity", "competitive_terms",
    ]


WIDE_FEATURES = wide_names(lx.TIERS, lx.WIDE_WORDS)


def wide_profile(
    df: DataFrame, text: str, tiers: Mapping[str, tuple[float, Sequence[str]]] | None = None,
    words: Mapping[str, Sequence[str]] | None = None, literal: bool = False,
) -> DataFrame:
    """Append the 30 features of `text`.

    literal=True gives what patterns with doubled backslashes count on ordinary text: nothing for
    every word-bounded list, the tiers and Big-O, and no expansion of abbreviations.
    """
    tiers = lx.TIERS if tiers is None else tiers
    words = lx.WIDE_WORDS if words is None else words
    t = F.col("_norm")
    base = _prepared(df, text, {} if literal else lx.FULL_EXPANSIONS)
    if literal:
        # Line breaks stay: the text is only lowered and stripped, and "." stops at a line's end.
        lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
        base = base.withColumn("_norm", F.regexp_replace(lowered, f"^{SPACE}+|{SPACE}+$", ""))

    def listed(terms: Sequence[str]) -> Column:
        return _zero() if literal else count_listed(t, F.col("_marked"), terms)

    def spans(sequences: Sequence[Sequence[str]]) -> Column:
        if literal:
            pattern = "|".join(".*".join(s) for s in sequences)
            return count(t, f"(?d){pattern}", *{s[-1] for s in sequences})
        return count_spans(t, sequences)

    def phrases(terms: Sequence[str]) -> Column:
        # One pass per phrase, so "binary search tree" also counts as "binary search".
        total = _zero()
        if not literal:
            for term in terms:
                total = total + count_standing(t, F.col("_marked"), term)
        return total

    cols = {name: phrases(terms) * F.lit(weight) for name, (weight, terms) in tiers.items()}
    cols["advanced_math_symbols"] = count(t, beyond_ascii(lx.WIDE_MATH))
    cols["mathematical_functions"] = listed(lx.MATH_FUNCTIONS)
    cols["big_o_notation"] = F.lit(0.0) if literal else count(t, lx.BIG_O, "o(") * F.lit(3.0)
    cols["time_complexity_mentions"] = spans(lx.TIME_MENTIONS) * F.lit(4.0)
    cols["space_complexity_mentions"] = spans(lx.SPACE_MENTIONS) * F.lit(3.0)
    constraint = "constraint|limit|bound" if literal else lx.CONSTRAINT_MENTIONS
    cols["constraint_patterns"] = count(
        t, constraint, "constraint", "limit", "bound", "≤") * F.lit(2.0)
    for name, terms in words.items():
        cols[name] = listed(terms)
    cols["sentence_count"] = F.size(
        F.filter(F.split(t, "[.!?]+"), lambda s: ~is_blank(s))).cast("bigint")
    cols["text_len"] = F.length(t).cast("bigint")
    cols |= _lexical(F.col("_words"), F.array_join(F.col("_words"), " "))
    cols["io_complexity"] = (
        spans(lx.IO_FORMAT) * F.lit(1.5) + spans(lx.IO_CASES) * F.lit(1.0)
        + count(t, lx.IO_SAMPLES, "example", "sample") * F.lit(0.5)
    )
    cols["competitive_terms"] = listed(lx.COMPETITIVE_TERMS)
    out = base.withColumns(cols)
    total = F.lit(0.0)
    for name in tiers:
        total = total + F.col(name)
    out = out.withColumns({
        "total_algorithm_score": total,
        "math_complexity_score": F.col("advanced_math_symbols") * F.lit(3.0)
        + F.col("mathematical_functions") * F.lit(2.0) + F.col("big_o_notation"),
        "complexity_score": F.col("time_complexity_mentions")
        + F.col("space_complexity_mentions") + F.col("constraint_patterns"),
        "avg_sentence_length": F.coalesce(
            F.try_divide(F.col("word_count"), F.col("sentence_count")), F.lit(0.0)),
    })
    return out.select(*df.columns, *wide_names(tiers, words))


def preview_profile(df: DataFrame, text: str, words: Sequence[str] | None = None) -> DataFrame:
    """Append length, symbol count, keyword hits and lexical diversity of the raw text.

    Word characters are ASCII here, as in a browser's regular expressions.
    """
    words = lx.PREVIEW_WORDS if words is None else words
    ascii_word = "[A-Za-z0-9_]"
    raw = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("_raw", raw).withColumn("_low", F.lower(F.col("_raw")))
    found = F.regexp_extract_all(
        F.col("_low"), F.lit(f"(?<!{ascii_word})[a-z]{{2,}}+(?!{ascii_word})"), F.lit(0))
    base = base.withColumns({"_found": found, "_marked": mark_words(F.col("_low"), ascii_word)})
    return base.withColumns({
        "length": F.length("_raw").cast("bigint"),
        "math_symbols": count(F.col("_raw"), lx.PREVIEW_SYMBOLS),
        "keywords": count_listed(F.col("_low"), F.col("_marked"), words),
        "lexical_diversity": F.coalesce(
            F.try_divide(F.size(F.array_distinct("_found")), F.size("_found")), F.lit(0.0)),
    }).drop("_raw", "_low", "_found", "_marked")
