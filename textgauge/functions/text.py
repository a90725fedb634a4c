"""Text preparation as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and word characters as a Unicode-aware scripting runtime sees them. Java's own \s and
# \b change meaning with flags and JDK versions, so both are spelled out.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"


def bounded(words: Iterable[str]) -> str:
    """A pattern for any of the words, standing alone."""
    return f"(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"


def strip(c: Column) -> Column:
    """Drop white space at both ends, Unicode spaces included."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return ~F.coalesce(F.regexp_like(c, F.lit(f"[^{SPACE[1:-1]}]")), F.lit(False))


def combine(description: Column, input_desc: Column, output_desc: Column) -> Column:
    """The three fields joined by single spaces; NULL counts as empty, inner spaces stay."""
    parts = [F.coalesce(c, F.lit("")) for c in (description, input_desc, output_desc)]
    return strip(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))


def plain_words(phrases: Iterable[str]) -> bool:
    """Whether all phrases are ASCII words joined by single spaces."""
    return all(re.fullmatch(r"\w+( \w+)*", p, re.A) for p in phrases)


def expand(c: Column, expansions: Mapping[str, str]) -> Column:
    """Spell out each abbreviation in turn, where it stands alone.

    Abbreviations and spellings of plain words are literals between the marks of words, which are set
    once; others need a regular expression each.
    """
    if not expansions:
        return c
    if not plain_words([*expansions, *expansions.values()]) or any(" " in short for short in expansions):
        for short, long in expansions.items():
            c = F.regexp_replace(c, bounded([short]), long)
        return c
    for own, instead in OWN_MARKS:
        c = F.replace(c, F.lit(own), F.lit(instead))
    c = mark_words(c)
    for short, long in expansions.items():
        c = F.replace(c, F.lit(marked(short)), F.lit(marked(long)))
    for mark in (OPEN, CLOSE):
        c = F.replace(c, F.lit(mark), F.lit(""))
    for own, instead in reversed(OWN_MARKS):
        c = F.replace(c, F.lit(instead), F.lit(own))
    return c


def flatten(c: Column) -> Column:
    """Lower case, one space for any run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+", " "))


def normalise(c: Column, expansions: Mapping[str, str] | None = None) -> Column:
    """Flattened text with abbreviations spelled out (they hold no spaces, so order is free)."""
    return expand(flatten(c), expansions or {})


def tokens(normalised: Column) -> Column:
    """White-space tokens of normalised text; empty text has none."""
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(
        F.split(normalised, " ")
    )


def cache_key(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def count(c: Column, pattern: str, *needs: str) -> Column:
    """Non-overlapping matches as bigint.

    `needs` are literals of which one must occur for the pattern to match at all: a plain substring
    search then spares most rows the regular expression.
    """
    n = F.regexp_count(c, F.lit(pattern)).cast("bigint")
    return F.when(_any_of(c, needs), n).otherwise(F.lit(0).cast("bigint")) if needs else n


def _any_of(c: Column, needs: Iterable[str]) -> Column:
    present = F.lit(False)
    for need in needs:
        present = present | F.contains(c, F.lit(need))
    return present


# Two Unicode noncharacters put around every word. A word standing alone is then a plain literal,
# and text that itself holds these characters changes nothing: they are no word characters.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
# What stands for a text's own marks while marks are to be taken away again; the first one is for the sign itself.
OWN_MARKS = [("\ufdd2", "\ufdd2!"), (OPEN, '\ufdd2"'), (CLOSE, "\ufdd2#")]


def mark_words(c: Column, word: str = WORD) -> Column:
    return F.regexp_replace(c, f"{word}+", f"{OPEN}$0{CLOSE}")


def marked(phrase: str) -> str:
    return " ".join(f"{OPEN}{w}{CLOSE}" for w in phrase.split(" "))


def count_standing(plain: Column, words_marked: Column, phrase: str) -> Column:
    """Occurrences of a phrase standing alone, without a regular expression.

    The plain text is searched first: it is shorter, and most phrases are in few texts.
    """
    literal = marked(phrase)
    gone = F.octet_length(words_marked) - F.octet_length(
        F.replace(words_marked, F.lit(literal), F.lit("")))
    n = (gone / F.lit(len(literal.encode()))).cast("bigint")
    return F.when(F.contains(plain, F.lit(phrase)), n).otherwise(F.lit(0).cast("bigint"))


def beyond_ascii(symbols: str) -> str:
    """A class of non-ASCII symbols that dismisses every ASCII character at its first check."""
    return f"[\\x{{80}}-\\x{{10ffff}}&&{symbols}]"


def count_listed(plain: Column, words_marked: Column, terms: Iterable[str]) -> Column:
    """Matches of any of the terms standing alone.

    Plain terms without a word in common cannot overlap, so their literal counts add up; other
    lists need the alternation.
    """
    terms = list(terms)
    parts = [w for term in terms for w in term.split(" ")]
    if all(w.isalnum() for w in parts) and len(parts) == len(set(parts)):
        total = F.lit(0).cast("bigint")
        for term in terms:
            total = total + count_standing(plain, words_marked, term)
        return total
    heads = [t.split(".")[0].split(" ")[0] for t in terms]
    return count(plain, bounded(terms), *heads)


def count_spans(c: Column, spans: Iterable[Iterable[str]]) -> Column:
    """Greedy matches of an alternation of literal sequences ("a.*b|c.*d") on one-line text.

    A match of a sequence runs from its first literal's next occurrence to its last literal's last
    one, so each sequence matches at most once and a few substring searches replace a regular
    expression that backtracks over the whole text from every start.
    """
    spans = [list(s) for s in spans]
    none = F.lit(0).cast("bigint")

    def last_end(literal: str) -> Column:
        tail = F.length(F.substring_index(c, literal, -1))
        return F.when(F.contains(c, F.lit(literal)), F.length(c) - tail).otherwise(F.lit(0))

    def step(state: Column) -> Column:
        found = []
        for order, seq in enumerate(spans):
            at = F.position(F.lit(seq[0]), c, state["at"] + 1)
            inner, ok = at, at > 0
            for prev, nxt in zip(seq, seq[1:-1]):
                inner = F.position(F.lit(nxt), c, inner + len(prev))
                ok = ok & (inner > 0)
            end = last_end(seq[-1])
            ok = ok & (end >= inner - 1 + len(seq[-2]) + len(seq[-1]))
            found.append(F.struct(F.when(ok, at).alias("from"), F.lit(order).alias("order"),
                                  F.when(ok, end).otherwise(state["at"]).alias("at")))
        hits = F.filter(F.array(*found), lambda s: s["from"].isNotNull())
        pick = F.array_min(hits)
        return F.when(F.size(hits) > 0, F.struct(pick["at"].alias("at"),
                                                 (state["n"] + 1).alias("n"))).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), none.alias("n"))
    rounds = F.array(*[F.lit(i) for i in range(len(spans))])
    possible = _any_of(c, {s[0] for s in spans}) & _any_of(c, {s[-1] for s in spans})
    folded = F.aggregate(rounds, start, lambda acc, _: step(acc), lambda acc: acc["n"])
    return F.when(possible, folded).otherwise(none)
