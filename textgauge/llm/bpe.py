"""Byte-level BPE: each distinct pre-token is encoded once, in a shuffle of distinct words.

1. Texts are cut into pre-tokens where they are read. The rows of a task make blocks of bounded size; a block has,
   for each document, the numbers of its pre-tokens by position, and a list of its distinct pre-tokens. That is the
   (document, position, word) table, with repeated words of a block folded before anything moves. The texts are cut
   twice, once for the lists and once for the numbers, as storing the numbers would cost more than making them.
2. The blocks' word lists, split into buckets by a hash of the word, are shuffled by bucket. A bucket's task encodes
   each distinct word once, whichever blocks it comes from, and answers each list with the ids.
3. The answers go back to their block by a join on it, and each document's ids are put together by position.

A word is in a block's list once, so a very common word makes one entry per block and no busy key. Decoding looks
up the bytes of each id in the table of ranks and joins them by position.

A block is named by a digest of its list and its place in the input (partition, number), so blocks of copies, whose
lists are equal, don't meet in one task. If the rows that the second cut sees make other blocks than those of the
first, or lie in other partitions, which takes an input that changes between two reads, the job fails; it never mixes
up numbers. So give it documents that are read from files or a checkpoint.

The result equals that of the tiktoken library for ranks and pattern, without special tokens. The merges of one
pre-token are that library's; the cutting into pre-tokens is done with class tables over code points here.

Defined cases: a null or empty text has no ids and decodes to nothing; rows without id or with repeated ids are each
encoded; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, per_worker, release, released

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 12 << 20
#: Buckets of words; at least as many as shuffle partitions.
BUCKETS = 64
#: Words that a bucket's task remembers; beyond it forgets them and may encode a word again.
REMEMBERED = 1_000_000
BLOCKS = "block string, bucket int, doc_ids array<bigint>, data binary"
ANSWERS = "block string, bucket int, data binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id bigint, ids array<int>"

LETTER, NUMBER, SPACE = 1, 2, 3


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def _classes() -> np.ndarray:
    """For each code point: letter, number, white space or other, by the Unicode properties of the pattern."""
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(prop, every):
            table[[ord(c) for c in m[0]]] = kind
    return table


def cut_points(text: str, classes: np.ndarray) -> list[int]:
    """Where the pre-tokens begin.

    Runs of one class are pre-tokens. The last character of white space before something else is cut off from the
    white space before it; if it is a blank it opens the next pre-token. An apostrophe that opens a pre-token
    takes a following s, t, m, d, re, ve or ll with it.
    """
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = len(points)
    if not n:
        return []
    kind = classes[points]
    start = np.empty(n + 4, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    if "'" in text:
        quotes = np.flatnonzero((points == 39) & start[:n])
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        first, second = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.zeros(len(quotes), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (first == ord(a)) & (second == ord(b))
        start[quotes[one | two] + 1] = False
        start[quotes[one] + 2] = True
        start[quotes[two] + 3] = True
    return np.flatnonzero(start[:n]).tolist()


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers below 2^32 as byte planes, compressed."""
    head = np.array([len(a) for a in arrays], dtype="<u4").tobytes()
    planes = [np.ascontiguousarray(a, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u4", n), 4 * n, []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out


def _frame(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "little")
        out.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return out


def _cut_blocks(batches: Iterator[pa.RecordBatch], buckets: int, block_chars: int, lists_only: bool,
                ) -> Iterator[pa.RecordBatch]:
    """The blocks' lists of words by bucket, or else their documents with the numbers of their words."""
    classes = per_worker("classes", _classes)
    part, places = TaskContext.get().partitionId(), count()

    def closed() -> Iterator[pa.RecordBatch]:
        data = [w.encode() for w in numbers]
        digest = hashlib.sha256(b"\xff".join(data)).hexdigest()
        name = f"{digest}-{part}-{next(places)}"
        if not lists_only:
            counts = np.array([len(c) for c in codes])
            yield _batch(BLOCK_TYPES, [[name], [-1], [doc_ids], [_pack(counts, np.concatenate(codes))]])
            return
        lists: list[list[int]] = [[] for _ in range(buckets)]
        for i, w in enumerate(data):
            lists[zlib.crc32(w) % buckets].append(i)
        for bucket, own in enumerate(lists):
            if own or not bucket:  # a block without words still has an answer
                lengths = np.array([len(data[i]) for i in own])
                letters = zstandard.ZstdCompressor(level=3).compress(b"".join([data[i] for i in own]))
                yield _batch(BLOCK_TYPES, [[name], [bucket], [None], [_frame(_pack(np.diff(own, prepend=0), lengths), letters)]])

    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    doc_ids, codes, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            at = cut_points(text, classes)
            pieces = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)] if at else []
            codes.append(np.fromiter(map(numbers.__getitem__, pieces), np.uint32, len(pieces)))
            doc_ids.append(doc_id)
            size += len(text) + 16
            if size >= block_chars:
                yield from closed()
                numbers = defaultdict(count().__next__)
                doc_ids, codes, size = [], [], 0
    if doc_ids:
        yield from closed()


BLOCK_TYPES = [("block", pa.string()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())]
ANSWER_TYPES = [("block", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())]


def _batch(types: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)],
                                      names=[n for n, _ in types])


def _encode_lists(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Answer each list of words with the words' numbers, how many ids each has, and the ids."""
    encode = per_worker(("tiktoken", path), lambda: _encoding(path)).encode_ordinary
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        for block, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data")), strict=True):
            numbers, letters = _unframe(data)
            steps, lengths = _unpack(numbers, 2)
            letters = zstandard.ZstdDecompressor().decompress(letters)
            ends = np.cumsum(lengths).tolist()
            found = []
            for a, b in zip([0, *ends][:-1], ends, strict=True):
                if (ids := known.get(word := letters[a:b])) is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ids = known[word] = encode(word.decode())
                found.append(ids)
            flat = np.array([i for ids in found for i in ids], dtype=np.uint32)
            yield _batch(ANSWER_TYPES, [[block], [bucket], [_pack(steps, np.array([len(i) for i in found]), flat)]])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ByteTable:
    """The bytes of every id, for decoding."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        size = max(ranks.values()) + 1
        self.sizes = np.zeros(size, dtype=np.int64)
        parts = [b""] * size
        for data, i in ranks.items():
            self.sizes[i], parts[i] = len(data), data
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[_spread(self.starts[ids], self.sizes[ids])].tobytes()


def _documents(blocks: pa.Table, answers: pa.Table) -> Iterator[tuple[int | None, np.ndarray, list[int], list[str]]]:
    """Per document of a block: its id, its ids, its words' numbers; and for each word its ids as text."""
    parts = [_unpack(x, 3) for x in answers.column("data").to_pylist()]
    if blocks.num_rows and not parts:
        raise RuntimeError("the documents changed between two reads: read them from files or a checkpoint")
    numbers = [np.cumsum(steps).astype(np.int64) for steps, _, _ in parts]
    size = 1 + max((int(n[-1]) for n in numbers if len(n)), default=-1)
    sizes = np.zeros(size, dtype=np.int64)
    for own, (_, counts, _) in zip(numbers, parts, strict=True):
        sizes[own] = counts
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), dtype=np.int64)
    for own, (_, counts, ids) in zip(numbers, parts, strict=True):
        flat[_spread(starts[own], counts.astype(np.int64))] = ids
    values = list(map(str, flat.tolist()))
    texts = [" ".join(values[a:a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    del parts, numbers, values  # what follows takes its own room
    for doc_ids, data in zip(blocks.column("doc_ids").to_pylist(), blocks.column("data").to_pylist(), strict=True):
        counts, codes = _unpack(data, 2)
        ends = np.cumsum(counts).tolist()
        for doc_id, a, b in zip(doc_ids, [0, *ends[:-1]], ends, strict=True):
            own = codes[a:b]
            yield doc_id, flat[_spread(starts[own], sizes[own])], own.tolist(), texts


def _reassemble(documents: DataFrame, vocabulary: str | None, block_chars: int, work, schema: str) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, parts)
    rows = bounded(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(released(lambda b: _cut_blocks(b, buckets, block_chars, True)), BLOCKS).select("block", "bucket", "data")
    mine = rows.mapInArrow(released(lambda b: _cut_blocks(b, buckets, block_chars, False)), BLOCKS).select("block", "doc_ids", "data")
    answers = words.repartition(parts, "bucket").mapInArrow(released(lambda b: _encode_lists(b, path)), ANSWERS)

    def joined(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = work(blocks, found, path)
        release()
        return out

    return mine.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, schema)


def round_trip(documents: DataFrame, vocabulary: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of the bytes that they decode to."""

    def work(blocks: pa.Table, answers: pa.Table, path: str) -> pa.Table:
        table = per_worker(("bytes", path), lambda: ByteTable(path))
        rows = []
        for doc_id, ids, words, texts in _documents(blocks, answers):
            numbers = " ".join(map(texts.__getitem__, words))
            rows.append((doc_id, len(ids), hashlib.sha256(numbers.encode()).hexdigest(),
                         hashlib.sha256(table.decode(ids)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _reassemble(documents, vocabulary, block_chars, work, DIGESTS)


def encode_rows(documents: DataFrame, vocabulary: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: doc_id, its ids, their number, and the digests of `round_trip`."""

    def work(blocks: pa.Table, answers: pa.Table, path: str) -> pa.Table:
        table = per_worker(("bytes", path), lambda: ByteTable(path))
        rows = []
        for doc_id, ids, words, texts in _documents(blocks, answers):
            numbers = " ".join(map(texts.__getitem__, words))
            rows.append((doc_id, ids.astype(np.int32), len(ids),
                         hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(table.decode(ids)).hexdigest()))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _reassemble(documents, vocabulary, block_chars, work, f"doc_id bigint, ids array<int>, {DIGESTS[15:]}")


def encode(documents: DataFrame, vocabulary: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: doc_id and its ids."""

    def work(blocks: pa.Table, answers: pa.Table, _: str) -> pa.Table:
        found = [(d, ids) for d, ids, _, _ in _documents(blocks, answers)]
        return pa.table([pa.array([d for d, _ in found], pa.int64()),
                         pa.array([i for _, i in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _reassemble(documents, vocabulary, block_chars, work, IDS)


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row of doc_id and ids: doc_id and text (bytes that are no UTF-8 become the replacement character).

    The table of ranks has a fixed size and goes along with the tasks; null ids decode to a null text.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(("bytes", path), lambda: ByteTable(path))
        for batch in batches:
            texts = [None if x is None else table.decode(np.array(x, np.int64)).decode("utf-8", "replace")
                     for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id bigint, text string")
