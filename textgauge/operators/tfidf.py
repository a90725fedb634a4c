"""TF-IDF with sublinear counts, class-based term selection and population scaling.

Terms are kept in long form (key, term, n). Counts per document are made inside each row, so the
only shuffles are by term (map-side combined) and, for the terms that survive pruning, by document.
From the texts themselves, vocabulary and weights take digests of n-grams (grams) and make strings only
of those that may be in the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..session import cut
from . import grams

MAX_FEATURES = 4000
MIN_DF = 2
MAX_DF = 0.85
SELECTED = 3000
#: Cells of a dense block of weights in a task.
UNIT_CELLS = 1 << 22


def english() -> list[str]:
    """The default stop words: Spark's English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def words(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Lower-cased words of two or more characters without the stop words (English by default)."""
    stop_words = english() if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}{{2,}}+"), F.lit(0))
    if stop_words:
        # array_except would also drop repeats; the literal set makes this a hash look-up per word.
        found = F.filter(found, lambda w: ~w.isin(list(stop_words)))
    return found


def ngrams(tokens: Column, longest: int = 3) -> Column:
    """All 1- to n-grams, words joined by one space."""
    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n))
        grams = F.transform(starts, lambda i: F.concat_ws(
            " ", *[F.get(tokens, i + k) for k in range(n)]))
        return F.coalesce(grams, F.array().cast("array<string>"))

    return F.concat(tokens, *[of(n) for n in range(2, longest + 1)])


def term_counts(df: DataFrame, key: str, text: str, longest: int = 3,
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """(key, term, n) for every term of every document, without a shuffle.

    The row's sorted terms form runs; each run's start and the next one's give its length. The
    outer explode matters: for a plain one Catalyst infers a filter on the array, and pushing that
    down would put the whole array expression into every lambda call.
    """
    base = df.select(key, words(F.col(text), stop_words).alias("_w"))
    base = base.select(key, F.sort_array(ngrams(F.col("_w"), longest)).alias("_t"))
    index = F.sequence(F.lit(0), F.size("_t") - 1)
    starts = F.when(F.size("_t") > 0, F.filter(index, lambda i: (i == 0) | (
        F.get("_t", i) != F.get("_t", i - 1))))
    pairs = F.transform("_s", lambda s, j: F.struct(
        F.get("_t", s).alias("term"),
        (F.coalesce(F.get("_s", j + 1), F.size("_t")) - s).cast("bigint").alias("n")))
    runs = base.withColumn("_s", starts).select(key, pairs.alias("_r"))
    return runs.select(key, F.explode_outer("_r").alias("_p")).where("_p IS NOT NULL").select(
        key, "_p.*")


def vocabulary(counts: DataFrame, documents: int, max_features: int = MAX_FEATURES,
               min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """(term, df, total, idf) of the most frequent terms within the df limits; ties by term."""
    per = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    return _most_frequent(per, documents, max_features, min_df, max_df)


def _most_frequent(per: DataFrame, documents: int, max_features: int, min_df: int, max_df: float) -> DataFrame:
    kept = per.where((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    top = kept.orderBy(F.desc("total"), "term").limit(max_features)
    return top.withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)


def text_vocabulary(df: DataFrame, text: str, documents: int, longest: int = 3, stop_words: Sequence[str] | None = None,
                    max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """The vocabulary of the rows' texts, the same as from their term counts.

    A first pass counts buckets of n-grams, so a bucket's count is at least that of each term in it. A second counts the
    terms of the fullest buckets. If max_features of them fulfil the limits and are as frequent as the emptiest of these
    buckets, no other term can be in the vocabulary; else more buckets are taken.
    """
    tokens = df.select(words(F.col(text), stop_words).alias("_w"))
    totals = _bucket_totals(tokens, longest)
    ranked = np.sort(totals[totals > 0])[::-1]
    taken = 4 * max_features
    while True:
        # A term of fewer occurrences than min_df is in fewer rows than that.
        floor = max(int(ranked[taken - 1]) if taken <= len(ranked) else 1, min_df, 1)
        top = cut(_most_frequent(_term_totals(tokens, longest, totals >= floor), documents, max_features, min_df, max_df))
        found = top.agg(F.count("*"), F.min("total")).first()
        if floor <= max(min_df, 1) or (found[0] == max_features and found[1] >= floor):
            return top
        taken *= 8


def _bucket_totals(tokens: DataFrame, longest: int) -> np.ndarray:
    """Occurrences of n-grams by bucket: a table of fixed size, summed in parts."""
    part = 1 << 16

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = grams.bucket_totals(batches, longest)
        for at in range(0, len(totals), part):
            yield pa.RecordBatch.from_pydict({"part": pa.array([at // part], pa.int32()), "totals": pa.array(
                [totals[at:at + part].tobytes()], pa.binary())})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in rows["totals"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "totals": [total.tobytes()]})

    schema = "part int, totals binary"
    out = np.zeros(grams.BUCKETS, np.int64)
    for row in tokens.mapInArrow(counted, schema).groupBy("part").applyInPandas(added, schema).collect():
        out[row["part"] * part:(row["part"] + 1) * part] = np.frombuffer(row["totals"], np.int64)
    return out


def _term_totals(tokens: DataFrame, longest: int, wanted: np.ndarray) -> DataFrame:
    """(term, df, total) of the terms in wanted buckets."""
    shared = tokens.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in grams.slices(batch.column(0)):
                for terms, term, _, n in part.row_counts(longest, wanted):
                    yield pa.RecordBatch.from_pydict({
                        "term": pa.array(terms, pa.string()), "df": np.bincount(term, minlength=len(terms)),
                        "total": np.bincount(term, n, len(terms)).astype(np.int64)})

    return tokens.mapInArrow(counted, "term string, df bigint, total bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total").alias("total"))


def row_weights(tokens: Column, terms: Sequence[str], idf: Sequence[float], longest: int = 3) -> Column:
    """The known terms of a token array, as places in `terms`, with their raw weights (1 + ln n) * idf."""
    found = _known_entries(terms, idf, longest)
    entry = pa.struct([("i", pa.int32()), ("w", pa.float64())])

    def weighed(column: pa.Array) -> pa.Array:
        row, place, weight = found(column)
        ends = np.searchsorted(row, np.arange(len(column) + 1))
        values = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(weight, pa.float64())], fields=list(entry))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return F.arrow_udf(weighed, "array<struct<i:int,w:double>>")(tokens)


def row_units(tokens: Column, terms: Sequence[str], idf: Sequence[float], chosen: Sequence[int], longest: int = 3) -> Column:
    """The weights of the chosen terms, an array in their order, scaled to unit length over all known terms of the row."""
    found = _known_entries(terms, idf, longest)
    target = np.full(len(terms), -1)
    target[list(chosen)] = np.arange(len(chosen))
    step = max(1, UNIT_CELLS // len(chosen))

    def united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            row, place, weight = found(column)
            weight = weight / np.sqrt(np.bincount(row, weight * weight, len(column)))[row]
            at = target[place]
            row, at, weight = row[at >= 0], at[at >= 0], weight[at >= 0]
            made = []
            for first in range(0, len(column), step):
                size = min(step, len(column) - first)
                a, b = np.searchsorted(row, [first, first + size])
                cells = np.zeros((size, len(chosen)))
                cells[row[a:b] - first, at[a:b]] = weight[a:b]
                made.append(pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * len(chosen), pa.int32()), pa.array(cells.ravel())))
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))

    return F.arrow_udf(united, "array<double>")(tokens)


def _known_entries(terms: Sequence[str], idf: Sequence[float], longest: int):
    """A function of a column of token arrays: row, place of a known term, raw weight, ordered by row and place."""
    places = {t: i for i, t in enumerate(terms)}
    idf, wanted = np.array(idf, float), np.packbits(grams.buckets_of(list(terms)))

    def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flags = np.unpackbits(wanted).astype(bool)
        row, place, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in grams.slices(column):
            for found, term, at, n in part.row_counts(longest, flags):
                known = np.array([places.get(t, -1) for t in found])[term]
                keep = known >= 0
                row.append(at[keep] + part.first)
                place.append(known[keep])
                count.append(n[keep])
        row, place, count = map(np.concatenate, (row, place, count))
        order = np.lexsort((place, row))
        row, place, count = row[order], place[order], count[order]
        return row, place, (1 + np.log(count)) * idf[place]

    return entries


def text_weights(df: DataFrame, key: str, text: str, vocab: DataFrame, longest: int = 3,
                 stop_words: Sequence[str] | None = None) -> DataFrame:
    """(key, term, weight) of the rows' texts, the same as from their term counts.

    A row travels to the others of its key with places and weights of its known terms; the terms, of which there are
    max_features at most, are put in their places afterwards.
    """
    known = vocab.select("term", "idf").orderBy("term").collect()
    if not known:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).where("false")
    raw = df.select(key, row_weights(words(F.col(text), stop_words), [r["term"] for r in known], [r["idf"] for r in known],
                                     longest).alias("_g")).where(F.size("_g") > 0)
    squares = F.aggregate("_g", F.lit(0.0), lambda s, g: s + g["w"] * g["w"])
    norm = F.sqrt(F.sum("_s").over(Window.partitionBy(key)))
    long = raw.withColumn("_s", squares).withColumn("_n", norm).select(key, "_n", F.explode("_g").alias("_p"))
    names = df.sparkSession.createDataFrame([(i, r["term"]) for i, r in enumerate(known)], "_i int, term string")
    return long.select(key, F.col("_p.i").alias("_i"), (F.col("_p.w") / F.col("_n")).alias("weight")).join(
        F.broadcast(names), "_i").select(key, "term", "weight")


def weights(counts: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(key, term, weight): (1 + ln n) * idf, scaled to unit length per document.

    The vocabulary has at most max_features rows, so it is broadcast and the terms outside it are
    dropped before the one shuffle by document.
    """
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn(
        "_w", (1 + F.log("n")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("_w") / norm).select(key, "term", "weight")


def class_scores(weighted: DataFrame, classes: DataFrame, key: str, label: str) -> DataFrame:
    """χ² of each term's weight sums against the class shares: (term, score).

    Only classes in which a term occurs have a row for it. The others add their expected weight, and
    the expected weights of all classes sum to the term's total.
    """
    shares = classes.groupBy(label).agg(F.count("*").alias("_n"))
    shares = shares.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy()))
    sums = weighted.join(classes.select(key, label), key).groupBy("term", label).agg(
        F.sum("weight").alias("observed"))
    total = F.sum("observed").over(Window.partitionBy("term"))
    joined = sums.withColumn("total", total).join(shares.select(label, "share"), label)
    expected = F.col("share") * F.col("total")
    return joined.groupBy("term").agg(
        (F.sum(F.pow(F.col("observed") - expected, 2) / expected - expected) + F.first("total"))
        .alias("score"))


def select_terms(scores: DataFrame, k: int = SELECTED) -> DataFrame:
    """The k best terms with their feature index (by term); k bounds the one-task numbering."""
    top = scores.orderBy(F.desc("score"), "term").limit(k)
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, std) with population std; 0 becomes 1. One aggregate row, then unpivoted."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                    for c in columns])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in columns])).alias("p"))
    return long.select("p.name", "p.s.mean", F.when(F.col("p.s.std") > 0, F.col("p.s.std"))
                       .otherwise(1.0).alias("std"))


def scale(df: DataFrame, columns: Sequence[str], scaler: dict[str, tuple[float, float]],
          ) -> DataFrame:
    """Standardise columns with fitted (mean, std) pairs."""
    return df.withColumns({
        c: (F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1]) for c in columns})
