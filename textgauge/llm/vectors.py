"""Exact top-k inner products with bounds from multi-resolution segment statistics.

Components become floor(256 * x). For a segment of length l of two vectors with means m, n and deviations s, t, the
part of the inner product that lies in it is at most l (m n + s t); the same statistics give the lower bound
l ((m - n)^2 + (s - t)^2) of the part of their squared distance. The sum over segments is a bound for the whole, and
it tightens as segments get shorter. Candidates go from coarse to fine; those whose bound falls below the k-th
best score known for a query are out, and the others are scored exactly.

The stated query set is taken in blocks of QUERY_BLOCK vectors. A block is broadcast and meets all candidates where
they are read; each task keeps its k best per query, and what is shuffled is at most k rows per query and
task. A bounded sample of candidates, scored exactly first, gives each query a floor for its k-th score.

Defined cases: rows whose id or vector is null, or whose vector holds null or non-finite components, take no part;
only vectors of the same length are compared; of several rows with a query's id the smallest vector asks, and none
of them is a candidate for it; ties go to the smaller vec_id; an empty table has no result; further columns are
ignored. Scores beyond 64 bits are cut to the 64-bit range.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
EVERY = 50
QUERY_BLOCK = 2048
SAMPLE = 2048
STRIPE = 512
#: Pairs whose numbers are gathered at a time.
PAIRS = 1 << 16
#: Segments of a vector at each level, as far as its length allows.
LEVELS = (1, 4, 16)
RESULT = "query_id bigint, vec_id bigint, score bigint"


class Block(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray
    floor: np.ndarray  # a score that the k-th best of each query reaches


def _usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _prepared(embeddings: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    return (embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("v"))
            .where(F.col("vec_id").isNotNull() & _usable(F.col("v"))))


def _whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(vectors, -1e300, 1e300) * 256)


def _are_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products of their components are exact as floats."""
    return bool(np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2.0 ** 52)


def _bounds(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose dot product with those of another vector bounds the inner product from above."""
    out = [np.zeros(len(vectors))]
    if not vectors.shape[1]:
        return np.stack(out, axis=1)
    for part in np.array_split(vectors, min(segments, vectors.shape[1]), axis=1):
        scale = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * scale, part.std(axis=1) * scale]
    return np.stack(out, axis=1)


def _dots(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of the rows q of a with the rows c of b."""
    parts = [np.einsum("ij,ij->i", a[q[i:i + PAIRS]], b[c[i:i + PAIRS]]) for i in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _exact(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The dot products as int64: in floats while these are exact, else in Python integers."""
    if _are_exact(a, b):
        return _dots(a, b, q, c).astype(np.int64)
    x, y = ([[int(v) for v in row] for row in part] for part in (a, b))
    sums = [sum(map(operator.mul, x[i], y[j])) for i, j in zip(q.tolist(), c.tolist(), strict=True)]
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in sums], dtype=np.int64)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """The places of the top rows of each query, best first."""
    order = np.lexsort((ids, ~scores, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < top]


class Search:
    """The best candidates seen so far for a block of queries."""

    def __init__(self, block: Block, top: int):
        self.block, self.top, self.floor = block, top, block.floor.copy()
        self.levels = [_bounds(block.vectors, n) for n in LEVELS]
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = self.block.ids[:, None] != ids[None, :]
        if _are_exact(self.block.vectors, vectors):
            # Slack for rounding in the bounds, which may lose a few of the last digits.
            slack = 1e-9 * (1 + np.abs(self.block.vectors).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1])
            coarse = self.levels[0] @ _bounds(vectors, LEVELS[0]).T
            q, c = np.nonzero((coarse + slack >= self.floor[:, None]) & other)
            for n, mine in zip(LEVELS[1:], self.levels[1:], strict=True):
                keep = _dots(mine, _bounds(vectors, n), q, c) + slack >= self.floor[q]
                q, c = q[keep], c[keep]
        else:  # beyond what floats can bound
            q, c = np.nonzero(other)
        if not len(q):
            return
        scores = _exact(self.block.vectors, vectors, q, c)
        keep = scores.astype(float) >= self.floor[q]
        mine = tuple(np.concatenate(x) for x in zip(self.found, (q[keep], ids[c[keep]], scores[keep]), strict=True))
        best = _best(*mine, self.top)
        self.found = tuple(x[best] for x in mine)
        counts = np.bincount(self.found[0], minlength=len(self.floor))
        last = np.cumsum(counts) - 1
        full = counts == self.top
        self.floor[full] = np.maximum(self.floor[full], self.found[2][last[full]].astype(float))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of a batch, in stripes of rows with vectors of one length."""
    ids = batch.column("vec_id").to_numpy()
    column = batch.column("v")
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        for at in range(0, len(rows), STRIPE):
            own = rows[at:at + STRIPE]
            yield ids[own], _whole(flat[starts[own][:, None] + np.arange(width)])


def _blocks(queries: DataFrame, sample: list, top: int, size: int) -> Iterator[Block]:
    """Blocks of queries of one vector length, of at most about size rows each."""
    counts = {r["width"]: r["n"] for r in queries.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    for width, n in sorted(counts.items()):
        parts = -(-n // size)
        number = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
        known = [r for r in sample if len(r["v"]) == width]
        for part in range(parts):
            rows = queries.where((F.size("v") == width) & (number == part)).collect()
            if not rows:
                continue
            block = Block(np.array([r["vec_id"] for r in rows], np.int64),
                          _whole(np.array([r["v"] for r in rows], float).reshape(len(rows), width)), np.full(len(rows), -np.inf))
            first = Search(block, top)
            for at in range(0, len(known), STRIPE):
                own = known[at:at + STRIPE]
                first.add(np.array([r["vec_id"] for r in own], np.int64),
                          _whole(np.array([r["v"] for r in own], float).reshape(len(own), width)))
            yield block._replace(floor=first.floor)


def search(embeddings: DataFrame, every: int = EVERY, top: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The top candidates of each row whose id is divisible by every: query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    rows = _prepared(embeddings)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).collect()
    found = spark.createDataFrame([], RESULT)
    for block in _blocks(queries, sample, top, query_block):
        held = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            mine = Search(held.value, top)
            for batch in batches:
                for ids, vectors in _rows(batch):
                    if vectors.shape[1] == held.value.vectors.shape[1]:
                        mine.add(ids, vectors)
            q, ids, scores = mine.found
            yield pa.RecordBatch.from_arrays([pa.array(held.value.ids[q]), pa.array(ids), pa.array(scores)],
                                             names=["query_id", "vec_id", "score"])

        found = found.union(rows.mapInArrow(scan, RESULT))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
