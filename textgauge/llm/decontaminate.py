"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts become lower-case words joined by single blanks, in UTF-8. A test string is a window of an item: the bytes
of its words with a blank on either side. Test strings are put in classes of like length. For each class a shift
table says, for a block of bytes at the end of the current position, how far the next possible position is; where
the shift is zero, the block's bucket names the strings to try, and they are compared directly.

The search runs over the concatenated texts of a slice from many starting points at once, so each step of it is a
few numpy calls. Documents are never shuffled: the test strings are broadcast in chunks of bounded size, each one
pass over the documents.

Defined cases: a null or empty text has no words; a document row without id keeps its null; repeated rows are
reported each; benchmark rows without id or words are left out; rows with the same item_id are one item; an empty
benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, arrow_pass, bounded, released, slices, utf8

WINDOW = 10
#: Bytes of benchmark texts in one broadcast chunk.
CHUNK_BYTES = 16 << 20
RESULT = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
STATE = "doc_id bigint, text string, spans array<bigint>, items array<string>"
#: Lower bounds of the classes of test strings by length, with the block length of each.
CLASSES = [(3, 2), (8, 4), (16, 8), (40, 8)]
MIX = np.uint64(0x9E3779B97F4A7C15)


class Tables(NamedTuple):
    least: int  # length of the shortest string
    block: int
    bits: int
    shift: np.ndarray  # by hash of a block
    suffixes: np.ndarray  # sorted blocks that end a prefix of that length
    heads: np.ndarray  # sorted blocks that begin a string
    widths: list[int]  # lengths in words


class Matcher(NamedTuple):
    classes: list[Tables]
    owners: dict[bytes, list[str]]


def _hash(blocks: np.ndarray, bits: int) -> np.ndarray:
    return ((blocks.astype(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """All blocks of width bytes, as integers; a view."""
    return np.ndarray((max(0, len(data) - width + 1),), dtype=f"<u{width}", buffer=data, strides=(1,))


def build_matcher(items: list[tuple[str, str]], window: int = WINDOW) -> Matcher:
    owners: dict[bytes, set[str]] = {}
    lengths: dict[bytes, int] = {}
    for name, text in items:
        words = text.encode().translate(WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        width = min(window, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            key = b" " + b" ".join(words[i:i + width]) + b" "
            owners.setdefault(key, set()).add(name)
            lengths[key] = width
    classes = []
    for (low, block), high in zip(CLASSES, [*[x for x, _ in CLASSES[1:]], 1 << 60], strict=True):
        strings = [k for k in owners if low <= len(k) < high]
        if not strings:
            continue
        least = min(map(len, strings))
        heads = np.frombuffer(b"".join(k[:least] for k in strings), dtype=np.uint8).reshape(len(strings), least)
        places = least - block + 1
        bits = int(min(22, max(12, np.ceil(np.log2(len(strings) * places * 8)))))
        shift = np.full(1 << bits, places, dtype=np.int64)
        for at in range(places):
            ends = np.ascontiguousarray(heads[:, at:at + block]).view(f"<u{block}").ravel()
            h = _hash(ends, bits)
            shift[h] = np.minimum(shift[h], places - 1 - at)
        first = np.ascontiguousarray(heads[:, :block]).view(f"<u{block}").ravel()
        classes.append(Tables(least, block, bits, shift, np.unique(ends), np.unique(first),
                              sorted({lengths[k] for k in strings})))
    return Matcher(classes, {k: sorted(v) for k, v in owners.items()})


def _known(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _positions(data: np.ndarray, t: Tables) -> np.ndarray:
    """Where a string of the class can begin: zero shift, its end block and its first block are known."""
    last = len(data) - t.least
    if last < 0:
        return np.empty(0, dtype=np.int64)
    blocks, offset = _blocks(data, t.block), t.least - t.block
    starts = np.linspace(0, last + 1, max(1, min(4096, last // 512)) + 1).astype(np.int64)
    at, stop, found = starts[:-1].copy(), starts[1:].copy(), []
    while len(at):
        step = t.shift[_hash(blocks[at + offset], t.bits)]
        if (zero := step == 0).any():
            found.append(at[zero])
        at = at + np.maximum(step, 1)
        if (going := at < stop).sum() < len(at):
            at, stop = at[going], stop[going]
    places = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    places = places[_known(t.suffixes, blocks[places + offset])]
    return places[_known(t.heads, blocks[places])]


def _search(texts: list[bytes], matcher: Matcher) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: its words, the word ranges of all occurrences, and the items they belong to."""
    joined = b" " + b"".join(x.translate(WORD_BYTES) + b" \0 " for x in texts)
    raw = np.frombuffer(joined, dtype=np.uint8)
    blank = raw == 32
    data = np.ascontiguousarray(raw[~np.concatenate([[False], blank[1:] & blank[:-1]])])
    blanks = np.flatnonzero(data == 32)
    ends = np.flatnonzero(data[blanks[:-1] + 1] == 0)  # the word number of each text's end mark
    first = np.concatenate([[0], ends[:-1] + 1])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    whole = data.tobytes()
    for t in matcher.classes:
        places = _positions(data, t)
        places = places[data[places] == 32]
        for word in np.searchsorted(blanks, np.sort(places)).tolist():
            for width in t.widths:
                if word + width < len(blanks) and (
                        names := matcher.owners.get(whole[blanks[word]:blanks[word + width] + 1])):
                    text = int(np.searchsorted(ends, word))
                    spans[text].append((word - int(first[text]), word - int(first[text]) + width))
                    items[text].update(names)
    return ends - first, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The number of chunks of about chunk_bytes, and the items of each, fetched when asked for."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([(r.item_id, r.text) for r in items.where(part == i).collect()] for i in range(n))


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: its words, those inside an occurrence of a window, and the items that occur."""
    spark = documents.sparkSession
    n, chunks = _chunks(benchmark, chunk_bytes)
    df = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n > 1:
        df = df.withColumns({"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    for i, chunk in enumerate(chunks):
        matcher = spark.sparkContext.broadcast(build_matcher(chunk, window))
        done = i == n - 1

        def work(batch: pa.RecordBatch, matcher=matcher, done=done) -> list:
            texts = utf8(batch.column("text"))
            counts, spans, items = _search(texts, matcher.value)
            if "spans" in batch.schema.names:
                for mine, old in zip(spans, batch.column("spans").to_pylist(), strict=True):
                    mine.extend(zip(old[::2], old[1::2], strict=True))
                for mine, old in zip(items, batch.column("items").to_pylist(), strict=True):
                    mine.update(old)
            merged = [_merged(x) for x in spans]
            if not done:
                return [batch.column("doc_id"), batch.column("text"), [[y for x in m for y in x] for m in merged],
                        [sorted(x) for x in items]]
            hit = [sum(b - a for a, b in x) for x in merged]
            return [batch.column("doc_id"), counts.tolist(), hit, [len(x) for x in items],
                    [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], [x > 0 for x in hit]]

        df = arrow_pass(df, RESULT if done else STATE, work)
    return df


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs; a document id that is null is kept if its row is clean.

    The verdict travels with the row: texts are searched where they are read, nothing is joined.
    """
    df = documents
    for chunk in _chunks(benchmark, CHUNK_BYTES)[1]:
        matcher = documents.sparkSession.sparkContext.broadcast(build_matcher(chunk))

        def keep(batches, matcher=matcher):
            for part in slices(batches):
                _, spans, _ = _search(utf8(part.column("text")), matcher.value)
                yield part.filter(pa.array([not x for x in spans], pa.bool_()))

        df = bounded(df).mapInArrow(released(keep), df.schema)
    return df
