"""Spelling variants: words one inserted, deleted or replaced character apart, by asymmetric chunks.

Of two words that differ by one edit let the first be the shorter, or either if they are equally long. It is cut into
two disjoint chunks, its halves. One edit touches one of them at most, so the other stands unchanged in the second
word, where it starts at the same place or, behind an inserted character, one further. The first word contributes its
two chunks, the second the positional grams of their lengths that lie within that shift; where a chunk meets an equal
gram, the pair is a candidate.

A half alone is shared by thousands of words of a large vocabulary, and the pairs of such a group would grow with its
square. The same argument holds inside the half that the edit touched: of its two quarters one is unchanged, at the
same place or one further. So a key is a half together with a quarter of the rest. Every pair one edit apart
still meets in a key, the groups are smaller by orders of magnitude, and the adaptive skew join splits those that are
large nevertheless. All candidates are verified; no group is cut.

Each word points to the most frequent word next to it if that is RATIO times as frequent or more, its form. Frequencies
grow along forms, so chains are no longer than the logarithm of the largest; they are followed by doubling.

Words are counted on all texts with Spark's own functions; equal words are counted in each task before they are
shuffled, so frequent words cost nothing more.

Defined cases: null and empty texts have no words; documents without id and with repeated ids count like others;
words below the least length or frequency are left out, also as forms; of equally frequent forms the smallest in code
point order is taken; a word without form is its own root; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Letters of words; a run of them is a word.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
#: How many times as frequent as a word its form must be.
RATIO = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per maximal run of min_length letters or more in the texts: doc_id, run, lower-cased in A-Z alone."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.explode(found).alias("run"))
    return rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The distinct values of column word that are long and frequent enough: word, n."""
    long = words.where(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(length: Column, moved: bool) -> Column:
    """The four keys of a word: a half and a quarter of the rest, with the places they have in a word of that length.

    With moved, the word is one longer than length, by a character in the part that is not in the key.
    """
    half = F.floor(length / 2).cast("int")
    one = F.lit(int(moved))

    def quarter(start: Column, size: Column, which: int) -> Column:
        first = F.floor(size / 2).cast("int")
        place, width = (start, first) if which == 0 else (start + first, size - first)
        # The first quarter stays where it is; the second stands behind the inserted character.
        return F.substr("word", place + 1 + (one if which else F.lit(0)), width)

    keys = []
    for which in (0, 1):
        # The first half is unchanged: the rest is [half, length).
        keys.append(F.xxhash64(F.lit(which), length, F.substr(F.col("word"), F.lit(1), half),
                               quarter(half, length - half, which)))
        # The second half is unchanged: the rest is [0, half).
        keys.append(F.xxhash64(F.lit(2 + which), length, F.substr(F.col("word"), half + 1 + one, length - half),
                               quarter(F.lit(0), half, which)))
    return F.array(*keys)


def _merged(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join, never by a broadcast: Spark sizes a side by its compressed file, before rows are exploded and widened."""
    return left.join(right.hint("merge"), key, how)


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of the distinct words (word, n) exactly one edit apart, once each: a, a_n, b, b_n; a is no longer."""
    length = F.char_length("word")
    chunks = words.select(F.explode(_keys(length, False)).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    same = words.select(F.explode(_keys(length, False)).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"),
                        F.lit(True).alias("same"))
    longer = words.select(F.explode(_keys(length - 1, True)).alias("key"), F.col("word").alias("b"),
                          F.col("n").alias("b_n"), F.lit(False).alias("same"))
    met = _merged(chunks, same.union(longer), "key").where(~F.col("same") | (F.col("a") < F.col("b")))
    # An inserted character can leave several keys unchanged.
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").dropDuplicates(["a", "b"])


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per distinct word (word, n): its form, its root, the numbers of its near words and of its form's occurrences."""
    words = written(words, "words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("near")),
    )).alias("p")).select("p.*")
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    rows = _merged(words, found, "word", "left")
    more = -F.col("best.less")
    is_form = more >= ratio * F.col("n")
    rows = written(rows.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, more).alias("form_n")), "forms")
    return _merged(rows, roots(rows, ratio), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(rows: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The last of the forms that follow from each word with a form: word, root. The ratio is 2 or more."""
    pointed = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("form_n")).first()[0] or 0
    longest = 0
    while ratio ** (longest + 1) <= most:
        longest += 1
    steps = 1
    while steps < longest:  # a step doubles how far each word points
        onward = pointed.select(F.col("word").alias("root"), F.col("root").alias("next"))
        pointed = written(_merged(pointed, onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return pointed
