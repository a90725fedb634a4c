"""Word sequences (n-grams) of token arrays, counted in numpy inside a task without making a string for each.

Words get numbers, exact within a slice of rows, and digests, the same in all tasks. A gram's digest names one of BUCKETS;
strings are made only for different grams whose bucket is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

BUCKETS = 1 << 22
#: Words of a slice of rows that are worked on at once (a longer row is a slice of its own).
SLICE_WORDS = 1 << 20
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Slice:
    """Rows from `first` on: the numbers of all their words, each word's row, and the different words."""

    def __init__(self, values: pa.Array, offsets: np.ndarray, first: int):
        self.first, self.rows = first, len(offsets) - 1
        coded = values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = coded.dictionary.to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.rows), np.diff(offsets))

    def buckets(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n from 1 to longest: n, where each n-gram starts, and its bucket."""
        word = _digests(self.known)[self.code]
        gram = word
        for n in range(1, longest + 1):
            if n > 1:
                gram = gram[:-1] * _MULTIPLY + word[n - 1:]
            if not len(gram):
                return
            start = np.flatnonzero(self.row[:len(gram)] == self.row[n - 1:])
            yield n, start, _bucket(gram[start])

    def numbered(self, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of the n-gram at each start, and for each number a start."""
        number = self.code[start]
        for k in range(1, n):
            number = np.unique(number * len(self.known) + self.code[start + k], return_inverse=True)[1]
        _, at, number = np.unique(number, return_index=True, return_inverse=True)
        return number, start[at]

    def terms(self, start: np.ndarray, n: int) -> list[str]:
        return [" ".join(g) for g in self.known[self.code[start[:, None] + np.arange(n)]]]

    def row_counts(self, longest: int, wanted: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the different terms in wanted buckets and, a row and term, (term, row, count)."""
        for n, start, bucket in self.buckets(longest):
            start = start[wanted[bucket]]
            if len(start):
                number, at = self.numbered(start, n)
                pair, count = np.unique(number * self.rows + self.row[start], return_counts=True)
                yield self.terms(at, n), pair // self.rows, pair % self.rows, count


def _digests(known: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)


def _bucket(gram: np.ndarray) -> np.ndarray:
    mixed = (gram ^ (gram >> np.uint64(32))) * _MIX
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def slices(tokens: pa.ListArray) -> Iterator[Slice]:
    """The rows of a column of token arrays (none null), in slices."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    first = 0
    while first < len(tokens):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_WORDS, side="right")) - 1)
        yield Slice(tokens.values, offsets[first:last + 1], first)
        first = last


def bucket_totals(batches: Iterator[pa.RecordBatch], longest: int) -> np.ndarray:
    """How many grams of the first column fall into each bucket."""
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch.column(0)):
            for _, _, bucket in part.buckets(longest):
                np.add.at(totals, bucket, 1)
    return totals


def buckets_of(terms: list[str]) -> np.ndarray:
    """True for the buckets of the terms, words joined by one space."""
    wanted = np.zeros(BUCKETS, bool)
    for term in terms:
        word = _digests(np.array(term.split(" "), dtype=object))
        gram = word[:1]
        for k in range(1, len(word)):
            gram = gram * _MULTIPLY + word[k:k + 1]
        wanted[_bucket(gram)] = True
    return wanted
