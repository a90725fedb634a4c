"""N-gram Jaccard join with count vectors: groups of documents whose 5-word shingle sets are alike.

A document is the set of 64-bit hashes of its shingles. Documents with the same set are one class, known by a
hash of the set, so copies cost nothing beyond the first pass. Two sets of sizes a and b link when their overlap is
at least 4/9 (a + b), which is a Jaccard similarity of 0.8; they then differ in at most (a + b) / 9 shingles.

Count vectors. Shingles are hashed into groups, and a document is the point of its group counts. The overlap of two
documents is at most the sum of the coordinate minima of their points, and of the corners of two boxes that hold
such points. Points are packed into an R-tree (sorted and tiled); pairs of boxes, then of points, whose bound falls
short are dropped, and the survivors are verified on the sets.

One tree over all points would have to be joined with itself, box by box. So the points are first dealt out to many
small trees by a second, finer grouping: it deals the shingles into more cells than two linked sets can differ in,
so these must agree in some cells entirely, and documents meet in the trees of the cells they agree in:

* The number of cells depends on the size class. A document takes part in its own class and the next smaller one,
  so that any two sizes within the ratio of 0.8 meet in a class.
* A cell is known by a sum of hashes of its shingles. Cells with two shingles or more are put in one global order
  (most shingles first) and only the first r + 1 of a document are used, r being the most cells it can differ in:
  two documents that agree in all but r of their cells share one among those. A document with too few such cells
  uses all that aren't empty, and if these are too few as well, the empty ones too.
* A cell that one class alone has is dropped at once.

Only connected groups are asked for. First each class is verified against the one partner with which it shares most
cells, and the links found are closed to components. In a few rounds, each component is then verified by one pair of
members against the one component with which it shares most cells. Cells whose members are in one component by then
are finished. The others are brought together by their smallest class: documents that are alike meet in many cells, most
of which have the same smallest class, so a document takes part in a few trees instead of one a cell, and a pair comes
up in a few places. A tree's members bring their sets. The bound is taken twice, first with the tree's few groups, then
with many, where little but links survives; survivors are verified on the spot unless links found before join them
already, so no more links leave a tree than it has members. Members of a large tree are cut into chunks of bounded
number and bytes, and each pair of chunks is a task of its own.

The sets are never kept as a table of all documents: they are made anew from the texts in each of the three passes,
and only those of classes that share a cell are shuffled.

Exactness rests on 64-bit hashes: two different shingles or sets are taken as equal with a chance of 2^-64 a pair.

Defined cases: null and empty texts have no shingles and are a component of their own; fewer than five words are one
shingle; repeated rows and texts are each reported, copies in one component; rows without doc_id get a null
component and link nothing; rows with the same doc_id are separate documents; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textgauge.session import cut as checkpointed

from .common import arrow_pass, bounded, per_worker, released, shuffles_freed, slices, utf8, written

WORDS = 5
#: Blank characters to a blank, A-Z to lower case.
BYTES = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Coordinates of a point in the tree, and of the finer points that its survivors are bounded by. Groups are the
#: leading bits of shingles, so sums of neighbouring groups are the coordinates of a coarser point. Documents of
#: LARGE shingles and more have the second number of fine groups.
GROUPS, FINE, LARGE = 64, (256, 1024), 1024
#: Rounds of links between representatives of components that meet in a cell.
ROUNDS = 1
LEAF, FANOUT = 32, 16
#: Shingles per cell for the smallest documents of a size class.
LOAD = 2.2
#: Entries that a task collects before it deals them out; that a task holds of a bucket of cells.
FLUSH, HELD = 1 << 20, 1 << 22
#: Members of a cell beyond which they are passed on as they come; members, and bytes of sets, in a chunk of a tree.
BUSY, CHUNK, CHUNK_BYTES = 1024, 1024, 4 << 20
#: Bytes of text whose entries are dealt to one bucket, on average.
BUCKET_BYTES = 64 << 20
#: Bits of the filter of wanted classes: FILTER_LOAD for each, within these bounds.
FILTER_LOAD, LEAST_BITS, MOST_BITS = 8, 1 << 23, 1 << 28

U64 = np.uint64
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (ODD, INVERSE):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of blank-separated bytes, a megabyte or one word at a time."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        stop = raw.find(b" ", at + (1 << 20))
        stop = len(raw) if stop < 0 else stop
        data = np.frombuffer(raw, np.uint8, stop - at, at)
        word = data != 32
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        few = (1 << 20) + (1 << 16)
        power, inverse = per_worker("powers", lambda: _powers(few)) if len(data) <= few else _powers(len(data))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * power[:len(data)], dtype=U64)])
        starts.append(a + at)
        hashes.append(mix((sums[b] - sums[a]) * inverse[a]))
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, U64))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    raw = b" ".join(x.translate(BYTES) for x in texts) + b" "
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    starts, words = word_hashes(raw)
    edges = np.searchsorted(starts, offsets).tolist()
    windows = mix(words + U64(WORDS))
    for j in range(1, WORDS):
        windows = mix(windows[:-1] * U64(ODD) + words[j:]) if len(windows) > 1 else windows[:0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(windows[a:b - WORDS + 1])
        elif b > a:  # the whole sequence, marked with its length
            h = mix(words[a:a + 1] + U64(b - a))
            for w in range(a + 1, b):
                h = mix(h * U64(ODD) + words[w:w + 1])
            yield h
        else:
            yield np.empty(0, U64)


def class_of(shingles: np.ndarray) -> int:
    """The class of a set: a hash of its members and size, as a signed integer."""
    total = mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64, keepdims=True)
    return int(mix(total + np.array([len(shingles)], dtype=U64)).astype(np.int64)[0])


def size_classes(largest: int) -> list[int]:
    """The smallest size of each class; below the first no two different sets link."""
    out = [4]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return out + [max(out[-1] + 1, -(-out[-1] * 5 // 4))]


def _cells(shingles: np.ndarray, k: int, low: int, most_apart: int) -> np.ndarray:
    """The cells a document uses in class k, whose smallest size is low."""
    n = int(low / LOAD) + 5
    seed = mix(np.array([k * 2 + 1], dtype=U64))
    mixed = mix(shingles ^ seed)
    cell = ((mixed >> U64(32)) * U64(n)) >> U64(32)
    order = np.argsort(cell, kind="stable")
    cell, mixed = cell[order], mix(mixed[order])
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    counts = np.diff(first, append=len(cell))
    keys = mix(np.add.reduceat(mixed, first) ^ mix(cell[first] + seed))
    heavy = counts >= 2
    need = most_apart + 1
    if heavy.sum() >= need:
        counts, keys = counts[heavy], keys[heavy]
        return keys[np.lexsort((keys, -counts))[:need]]
    if len(keys) >= need:
        return keys
    empty = np.setdiff1d(np.arange(n, dtype=U64), cell[first])
    return np.concatenate([keys, mix(mix(empty + seed) ^ seed)])


def cells_of(shingles: np.ndarray) -> np.ndarray:
    """All cells in which a document meets others."""
    n = len(shingles)
    if n < 4:
        return np.empty(0, U64)
    lows = size_classes(n)
    k = int(np.searchsorted(lows, n, side="right")) - 1
    out = [_cells(shingles, k, lows[k], n // 4)]
    if k and n <= (lows[k] - 1) * 5 // 4:
        out.append(_cells(shingles, k - 1, lows[k - 1], (n + lows[k] - 1) // 9))
    return np.concatenate(out)


def _shrink(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _grow(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


DEALT = "bucket int, cells binary, classes binary, which binary"


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The (cell, class) entries of the documents, dealt to buckets by cell; a class counts once in a flush."""
    def flush() -> Iterator[pa.RecordBatch]:
        cells = np.concatenate(held)
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
        ids = np.array(list(seen), dtype=np.int64)
        bucket = (cells >> U64(32)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cells, owner = cells[order], owner[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        for b in range(buckets):
            x, y = edges[b], edges[b + 1]
            if x < y:
                own, which = np.unique(owner[x:y], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([cells[x:y].tobytes()]), pa.array([ids[own].tobytes()]),
                     pa.array([_shrink(np.diff(which, prepend=0).astype("<i4"))])],
                    names=["bucket", "cells", "classes", "which"])

    held: list[np.ndarray] = []
    seen: dict[int, None] = {}
    size = 0
    for part in slices(batches):
        for shingles in shingle_sets(utf8(part.column("text"))):
            if len(shingles) < 4 or (name := class_of(shingles)) in seen:
                continue
            seen[name] = None
            held.append(cells_of(shingles))
            size += len(held[-1])
            if size >= FLUSH:
                yield from flush()
                held, seen, size = [], {}, 0
    if held:
        yield from flush()


MET = "kind int, cell bigint, class bigint, partner bigint, shared bigint"
MEMBER, STAR = 0, 1


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket: the members of each cell with several classes, and per class its partners.

    A cell's partner for all members is its smallest class. Cells with the same members get one name. When a bucket
    exceeds HELD entries, cells with more than BUSY members are passed on as they come.
    """
    names = [x.split()[0] for x in MET.split(", ")]

    def rows(kind, cell, member, partner=None, shared=None) -> pa.RecordBatch:
        n = len(member)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(cell.astype(np.int64) if cell is not None else [None] * n, pa.int64()),
             pa.array(member, pa.int64()), pa.array(partner if partner is not None else [None] * n, pa.int64()),
             pa.array(shared if shared is not None else [None] * n, pa.int64())], names=names)

    def grouped(cells: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries in order of cell and class, and where each cell starts."""
        order = np.lexsort((classes, cells))
        cells, classes = cells[order], classes[order]
        new = np.concatenate([[True], (cells[1:] != cells[:-1]) | (classes[1:] != classes[:-1])])
        cells, classes = cells[new], classes[new]
        return cells, classes, np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))

    def stars(member: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((partner, member))
        member, partner = member[order], partner[order]
        at = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (partner[1:] != partner[:-1])]))
        return rows(STAR, None, member[at], partner[at], np.diff(at, append=len(member)))

    def several(cells, classes, first, sizes) -> Iterator[pa.RecordBatch]:
        keep = np.repeat(sizes > 1, sizes)
        if not keep.any():
            return
        name = np.add.reduceat(mix(classes.astype(U64) ^ U64(0x1234567)), first) + sizes.astype(U64)
        name, partner = np.repeat(mix(name), sizes)[keep], np.repeat(classes[first], sizes)[keep]
        member = classes[keep]
        order = np.lexsort((member, name))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (member[order][1:] != member[order][:-1])])
        yield rows(MEMBER, name[order][new], member[order][new])
        other = member != partner
        yield stars(member[other], partner[other])

    def finish(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            cells, classes, first = grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from several(cells, classes, first, np.diff(first, append=len(cells)))

    bucket, held, size, limit, busy = None, [], 0, HELD, {}
    for batch in batches:
        for b, cells, classes, which in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if b != bucket:
                yield from finish(held)
                bucket, held, size, limit, busy = b, [], 0, HELD, {}
            x = np.frombuffer(cells, U64)
            y = np.frombuffer(classes, np.int64)[np.cumsum(_grow(which, "<i4"))]
            if busy:
                known = np.isin(x, np.fromiter(busy, U64, len(busy)))
                if known.any():
                    yield rows(MEMBER, x[known], y[known])
                    yield stars(y[known], np.array([busy[c] for c in x[known].tolist()], np.int64))
                    x, y = x[~known], y[~known]
            held.append((x, y))
            size += len(x)
            if size > limit:
                x, y, first = grouped(*(np.concatenate(v) for v in zip(*held, strict=True)))
                sizes = np.diff(first, append=len(x))
                many = np.repeat(sizes > BUSY, sizes)
                if many.any():
                    least = np.repeat(y[first], sizes)
                    busy |= dict(zip(x[many].tolist(), least[many].tolist(), strict=True))
                    yield rows(MEMBER, x[many], y[many])
                    other = many & (y != least)
                    yield stars(y[other], least[other])
                held = [(x[~many], y[~many])]
                size = len(held[0][0])
                limit = max(limit, 2 * size)
    yield from finish(held)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets have 100 times their overlap at 80 times their union or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    overlap = int((both[1:] == both[:-1]).sum())
    return 100 * overlap >= 80 * (len(a) + len(b) - overlap)


def point_of(shingles: np.ndarray) -> bytes:
    """The fine group counts of a document, in the least number of bytes each."""
    groups = FINE[len(shingles) >= LARGE]
    point = np.bincount((shingles >> U64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return point.astype(np.min_scalar_type(point.max(initial=0))).tobytes()


def points_of(data: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The points of documents in the fewest groups that any of them has."""
    groups = [FINE[int(n >= LARGE)] for n in sizes.tolist()]
    least = min(groups)
    rows = [np.frombuffer(x, f"<u{len(x) // g}").reshape(least, -1).sum(axis=1, dtype=np.uint32)
            for x, g in zip(data, groups, strict=True)]
    return np.stack(rows)


def tree_pairs(sizes: np.ndarray, fine: np.ndarray, groups: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows of different groups that a tree over the points cannot tell apart: by the bound they may link."""
    n = len(sizes)
    points = fine.reshape(n, GROUPS, -1).sum(axis=2, dtype=np.uint32)
    fine = fine.astype(np.uint8) if fine.max() < 256 else fine
    # Sort-tile packing: runs of like size, and within them runs of like first coordinates.
    order = np.lexsort((points[:, 1], points[:, 0], sizes * 8 // max(1, int(sizes.max()))))
    points, sizes, fine = points[order], sizes[order].astype(np.int64), fine[order]

    def boxes(high: np.ndarray, low: np.ndarray, top: np.ndarray, width: int):
        at = np.arange(0, len(high), width)
        return np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at)

    levels = [(points, sizes, sizes)]
    for width in (LEAF, FANOUT):
        levels.append(boxes(*levels[-1], width))

    def bounded(level: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        high, low, top = level
        keep = np.empty(len(i), dtype=bool)
        step = max(64, (4 << 20) // high.shape[1])  # some megabytes at a time
        for at in range(0, len(i), step):
            x, y = i[at:at + step], j[at:at + step]
            bound = np.minimum(high[x], high[y]).sum(axis=1, dtype=np.int64)
            keep[at:at + step] = ((9 * bound >= 4 * (low[x] + low[y])) & (5 * top[y] >= 4 * low[x])
                                       & (5 * top[x] >= 4 * low[y]))
        return keep

    def below(i: int, j: int, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(i * width, min(total, (i + 1) * width))
        b = np.arange(j * width, min(total, (j + 1) * width))
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        return (x[x <= y], y[x <= y]) if i == j else (x, y)

    found: list[tuple[int, int]] = []
    tops = len(levels[2][0])
    for i in range(tops):
        rest = np.arange(i, tops)
        for j in rest[bounded(levels[2], np.full(len(rest), i), rest)].tolist():
            x, y = below(i, j, FANOUT, len(levels[1][0]))
            keep = bounded(levels[1], x, y)
            for u, v in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                p, q = below(u, v, LEAF, n)
                apart = (p != q) & (groups[order[p]] != groups[order[q]])
                p, q = p[apart], q[apart]
                ok = bounded(levels[0], p, q)
                p, q = p[ok], q[ok]
                ok = bounded((fine, sizes, sizes), p, q)
                found += zip(order[p[ok]].tolist(), order[q[ok]].tolist(), strict=True)
    return found


class _Joined:
    """Union-find over components."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.above[max(x, y)] = min(x, y)


def _tree_join(table: pa.Table) -> pa.Table:
    """The links that join components among the members of one tree, or between two chunks of them."""
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    classes, sizes, comps, chunks = (column[c].to_numpy(zero_copy_only=False) for c in ("class", "n", "comp", "chunk"))
    a, b = column["low"][0].as_py(), column["high"][0].as_py()
    sets, joined, links = column["shingles"], _Joined(), []
    for i, j in tree_pairs(sizes, points_of(column["point"].to_pylist(), sizes), comps):
        if a != b and chunks[i] == chunks[j]:
            continue
        x, y = joined.root(int(comps[i])), joined.root(int(comps[j]))
        if x != y and _linked(np.frombuffer(sets[i].as_buffer(), U64), np.frombuffer(sets[j].as_buffer(), U64)):
            joined.join(x, y)
            links.append((int(classes[i]), int(classes[j])))
    del column, sets
    pa.default_memory_pool().release_unused()  # or the worker keeps what its largest tree took
    return pa.table([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())],
                    names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component, by large-star and small-star rounds until nothing changes.

    edges: a, b. The result has the columns node and comp, for all nodes but those that are their own smallest.
    """
    def pointed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    current = cut(pointed(edges))
    now = stamp(current)
    while now[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pointed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        current = cut(pointed(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .union(low.select("a", F.col("m").alias("b")))))
        before, now = now, stamp(current)
        if before == now:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cut(df: DataFrame) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        return checkpointed(df.select("*"))  # a plan made under the setting


def _written(df: DataFrame, name: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        return written(df, name)


def _filter_bits(ids: DataFrame) -> bytes:
    """A bit for the hash of every id. The table grows with the number of ids up to its bound; a full one only filters less."""
    n = ids.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_LOAD * n).bit_length()))
    place = F.pmod(F.xxhash64("class"), F.lit(size))
    # The functions count from 1.
    rows = ids.groupBy(F.bitmap_bucket_number(place + 1).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    width = 4096
    out = bytearray(size // 8)
    for r in rows:
        out[(r["at"] - 1) * width:r["at"] * width] = r["bits"]
    return bytes(out)


def _chosen_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Class, size, point and shingles of the wanted classes: the texts are read once more, no text is shuffled."""
    spark = documents.sparkSession
    bits = spark.sparkContext.broadcast(_filter_bits(wanted))
    plain = _texts(documents.where(F.col("doc_id").isNotNull()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            rows = []
            for s in shingle_sets(utf8(part.column("text"))):
                if len(s) >= 4 and (name := class_of(s)) not in seen and _has_bit(bits.value, name):
                    seen.add(name)
                    rows.append((name, len(s), point_of(s), s.tobytes()))
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["class", "n", "point", "shingles"])

    found = bounded(plain).mapInArrow(released(work), "class bigint, n bigint, point binary, shingles binary")
    return found.join(wanted, "class").groupBy("class").agg(
        F.first("n").alias("n"), F.first("point").alias("point"), F.first("shingles").alias("shingles"))


def _has_bit(bits: bytes, name: int) -> bool:
    at = _xxhash64_long(name) % (8 * len(bits))
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _xxhash64_long(value: int, seed: int = 42) -> int:
    """xxHash64 of one 8-byte integer, as the SQL function xxhash64 computes it, signed."""
    h = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets link."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"{c}_set"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keep = [_linked(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64))
                        for x, y in zip(part.column("a_set"), part.column("b_set"), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return bounded(joined).mapInArrow(released(work), "a bigint, b bigint")


def classify(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles and class (null without shingles)."""

    def work(batch: pa.RecordBatch) -> list:
        found = [(len(s), class_of(s) if len(s) else None) for s in shingle_sets(utf8(batch.column("text")))]
        return [batch.column("doc_id"), [n for n, _ in found], [c for _, c in found]]

    return arrow_pass(_texts(documents), "doc_id bigint, n_shingles bigint, class bigint", work)


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of cells in which several components meet, with their component and their cell's smallest class."""
    own = members.join(comps, members["class"] == comps["node"], "left").select(
        "cell", "class", F.coalesce("comp", "class").alias("comp"))
    cells = own.groupBy("cell").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("class").alias("lead")).where("low <> high")
    return cut(own.join(cells.select("cell", "lead"), "cell"))


def _chosen_pairs(own: DataFrame, turn: int) -> DataFrame:
    """One pair of classes for each component: its most frequent pair with the leading component of a cell.

    A cell's leading component is that with most members in it. Each component sends a member that the turn's hash
    chooses, so the pairs of a cell are as many as its components.
    """
    chance = F.xxhash64("class", F.lit(turn))
    senders = own.groupBy("cell", "comp").agg(F.min_by("class", chance).alias("class"), F.count("*").alias("n"))
    leaders = senders.groupBy("cell").agg(F.max_by(F.struct("comp", "class"), F.struct("n", "comp")).alias("lead"))
    met = senders.join(leaders, "cell").where(F.col("comp") != F.col("lead.comp")).select(
        "comp", F.col("lead.comp").alias("other"), F.col("class").alias("a"), F.col("lead.class").alias("b"))
    pairs = met.groupBy("comp", "other").agg(
        F.count("*").alias("n"), F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("pair"))
    best = pairs.groupBy("comp").agg(F.max_by("pair", F.struct("n", "other")).alias("pair"))
    return best.select("pair.a", "pair.b")


def _links(documents: DataFrame) -> DataFrame:
    """The component of every class that is linked with a smaller one: node, comp."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = _texts(documents.where(F.col("doc_id").isNotNull())).select("text")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * parts, -(-total // BUCKET_BYTES))
    dealt = bounded(plain).mapInArrow(released(lambda b: _deal(b, buckets)), DEALT)
    met = _written(dealt.repartition(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(released(_meet), MET), "cells")
    members = met.where(F.col("kind") == MEMBER).select("cell", "class")
    stars = met.where(F.col("kind") == STAR).groupBy("class", "partner").agg(F.sum("shared").alias("shared"))
    first = stars.groupBy("class").agg(F.max_by("partner", F.struct("shared", "partner")).alias("partner"))
    sets = _written(_chosen_sets(documents, members.select("class").distinct()), "sets")
    near = cut(_verified(first.select(F.col("class").alias("a"), F.col("partner").alias("b")), sets))
    comps = cut(components(near))
    own = _open(members, comps)
    for i in range(ROUNDS):
        new = cut(_verified(_chosen_pairs(own, i), sets))
        near = cut(near.union(new))
        comps = cut(components(near))
        own = _open(members, comps)
    return components(near.union(_tree_links(own, sets)))


def _tree_links(own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b that join the components that meet in open cells: all of them are joined that way."""
    left = cut(own.select("lead", "class", "comp").distinct().join(sets.select("class", "n"), "class"))
    sizes = left.groupBy("lead").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("chunks"))
    spread = (left.drop("n").join(sizes, "lead")
              .withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("lead", "class", "comp", "chunk", F.least("chunk", "other").alias("low"),
                      F.greatest("chunk", "other").alias("high")))
    return (spread.join(sets.select("class", "n", "point", "shingles"), "class").groupBy("lead", "low", "high")
            .applyInArrow(_tree_join, "a bigint, b bigint"))


def _grouped(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, class and component_id."""
    rows = _written(classify(documents), "classes")
    linked = _links(documents)
    least = rows.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    comp = least.join(linked, least["class"] == linked["node"], "left").select(
        "class", "least", F.coalesce("comp", "class").alias("comp"))
    best = comp.groupBy("comp").agg(F.min("least").alias("component"))
    named = comp.join(best, "comp").select(F.col("class").alias("of"), "component")
    # Rows without a class meet nothing: each gets a key of its own, so that they are no busy key.
    key = F.coalesce(F.col("class"), F.xxhash64("doc_id"))
    out = rows.withColumn("key", key).join(named, F.col("key") == F.col("of"), "left")
    component = (F.when(F.col("doc_id").isNull(), None).when(F.col("class").isNull(), F.col("doc_id"))
                 .otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "class", component.alias("component_id"))


def join(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that it reaches by links."""
    return _grouped(documents).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest doc_id; equal rows with that id are one document.

    Rows without id are kept. Decisions go by doc_id and class, since rows that share an id may differ in text. Rows
    whose id, by a filter of bits, is none of those that lose a row stay where they are; only the others are classified
    and joined with the decisions, so the texts that are shuffled are those of copies and of the filter's few errors.
    """
    tag, twice = f"class_{uuid.uuid4().hex}", f"twice_{uuid.uuid4().hex}"
    no_class = F.coalesce(F.col("class"), F.lit(0))
    decided = _written(_grouped(documents).where("doc_id is not null").groupBy("doc_id", no_class.alias(tag)).agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), (F.count("*") > 1).alias(twice)), "stay")
    losing = decided.where(~F.col("stays") | F.col(twice)).select(F.col("doc_id").alias("class")).distinct()
    bits = documents.sparkSession.sparkContext.broadcast(_filter_bits(losing))
    stay = decided.where("stays").drop("stays")
    schema = StructType([*documents.schema.fields, StructField(tag, LongType())])

    def split(part: pa.RecordBatch, lose: bool) -> pa.RecordBatch:
        ids = part.column("doc_id").cast(pa.int64()).to_pylist()
        return part.filter(pa.array([_has_bit(bits.value, i) == lose for i in ids], pa.bool_()))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield split(part, False)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if not (part := split(part, True)).num_rows:
                continue
            names = [class_of(s) if len(s) else 0 for s in shingle_sets(utf8(part.column("text")))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.int64())], names=[*part.schema.names, tag])

    known = bounded(documents).where("doc_id is not null")
    tagged = known.mapInArrow(released(add), schema).join(stay, ["doc_id", tag])
    kept = known.mapInArrow(released(untouched), documents.schema).union(tagged.where(~F.col(twice)).select(*documents.columns))
    if stay.where(F.col(twice)).limit(1).count():  # only rows that share id and set meet, so that other texts stay where they are
        kept = kept.union(tagged.where(F.col(twice)).dropDuplicates(["doc_id", tag]).select(*documents.columns))
    return kept.union(documents.where("doc_id is null"))
