"""Token ids as flat binary files with 64-bit document offsets, in ascending order of doc_id.

Documents are encoded where they are read; their ids are dealt by ranges of doc_id, whose bounds come from a sample of
the keys, and sorted there. Each range is written as one file of token ids, little-endian unsigned integers without any
header (16 bits where the vocabulary allows), each document closed by the end id, and beside it a file of 64-bit offsets:
where in the file of ids each document begins, and the file's length at the end. The manifest has one row per range. A
prefix sum over its lengths gives each file's base, the number of ids in all files before, so a document's place in the
whole is its file's base and its offset in it. The files are read back memory-mapped (by ranges where a store cannot be
mapped), in pieces of a file.

Encoding is per piece: the vocabulary drops white space, and its words end where punctuation begins, so a text cut at ASCII
white space, and between an ASCII or Latin-1 letter or an ASCII digit and punctuation other than an apostrophe, has the ids
of its pieces in order. Some megabytes of texts at a time are cut to distinct pieces, each looked up once; a task encodes
each distinct piece once while it knows it. Another vocabulary must keep to these two rules, and be
a byte-level one that leaves lower-case Latin words whole.

Files are named anew by each attempt of a task and count only if the manifest names them, so an executor that is lost
leaves files that nothing reads.

Defined cases: null and empty texts are the end id alone; rows without doc_id come first; rows with the same id follow
their place in the input; the special tokens' strings in a text are ordinary text; an empty table
gives no files; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_pass, new_file, open_store, per_worker, shared_path, slices, utf8, written

VOCABULARY = "word_bpe_49k.json"
END = 1
IDS, OFFSETS = "<u2", "<u8"
#: Bytes of text that a file is to hold, on average; keys in the sample that the ranges come from, for each range.
FILE_BYTES = 32 << 20
SAMPLE = 50
#: Bytes of text that are encoded together: each distinct piece of these is looked up once.
CODED_BYTES = 4 << 20
#: Bytes of a piece up to which its ids are kept, and how many are kept.
SHORT, KEPT = 48, 1 << 20
#: Documents that a reading task takes from a file.
READ_ROWS = 1 << 16
MANIFEST = "number int, file string, offsets string, ids string, n_rows bigint, n_tokens bigint"


BLANKS = b" \t\n\r\x0b\x0c"
#: Bytes as flags: no ASCII white space; an ASCII letter or digit; ASCII punctuation but an apostrophe; what a Latin letter
#: beyond ASCII begins with in UTF-8; its second byte.
SOLID, ALNUM, PUNCTUATION, LEAD, LATIN = 1, 2, 4, 8, 16
FLAGS = bytes(
    SOLID * (b not in BLANKS) | ALNUM * (b < 128 and chr(b).isalnum()) | PUNCTUATION * (33 <= b <= 126 and b != 39 and not chr(b).isalnum())
    | LEAD * (b == 0xC3) | LATIN * (0x80 <= b <= 0xBF and b not in (0x97, 0xB7)) for b in range(256))


#: Words of Latin letters in UTF-8: their letters have one lower-case letter each, and no mark follows.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
#: Words of lower-case ones: one word to the vocabulary too, and its normaliser leaves them alone.
PLAIN = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


def pieces_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of the texts, which of them each piece is, and where those of each text begin and end.

    Texts are cut where no token can span: at ASCII white space, and before punctuation behind a letter or digit.
    """
    data = b" ".join(texts) + b" "
    flags = np.frombuffer(data.translate(FLAGS), dtype=np.uint8)
    solid = (flags & SOLID).view(bool)
    letter = (flags & ALNUM) != 0
    letter[1:] |= ((flags[:-1] & LEAD) != 0) & ((flags[1:] & LATIN) != 0)
    new = np.append(True, ~solid[:-1] | (letter[:-1] & ((flags[1:] & PUNCTUATION) != 0)))
    starts = np.flatnonzero(solid & new)
    ends = np.flatnonzero(solid & np.append(~solid[1:] | new[1:], True)) + 1
    edges = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))
    offsets = np.cumsum(np.append(0, ends - starts), dtype=np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, BLANKS))]).dictionary_encode()
    return pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(), edges


def _lowered(piece: bytes) -> bytes:
    """The piece as the vocabulary's normaliser lowers its case, where that does not depend on marks; else as it is."""
    if piece.isascii():
        return piece.lower()
    return piece.decode().lower().encode() if LETTERS.fullmatch(piece) else piece


class Encoder:
    """Texts to ids, by the tokenizers library."""

    def __init__(self, path: str, dtype: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {path} do not fit {dtype}")
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct pieces: plain words by the vocabulary's merges alone, others by all of its steps."""
        word, letters = self.tokenizer.model.tokenize, self.letters
        out, others = {}, []
        for p in pieces:
            if PLAIN.fullmatch(p):
                ids = [t.id for t in word(p.decode() if p.isascii() else p.decode("latin-1").translate(letters))]
                out[p] = np.array(ids, dtype=self.dtype).tobytes()
            else:
                others.append(p)
        made = self.tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False)
        return out | {p: np.array(e.ids, dtype=self.dtype).tobytes() for p, e in zip(others, made, strict=True)}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        pieces, which, edges = pieces_of(texts)
        known = self.known
        if len(known) > KEPT:
            known.clear()
        ids = list(map(known.get, pieces))
        new = [p for p, x in zip(pieces, ids, strict=True) if x is None]
        if new:
            lowered = {p: _lowered(p) for p in new}
            found = self._learn([p for p in set(lowered.values()) if p not in known])
            made = {p: found[q] if q in found else known[q] for p, q in lowered.items()}
            known |= {p: x for p, x in (made | found).items() if len(p) <= SHORT}
            ids = [made[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
        # The ids of the distinct pieces stand one behind the other; each piece takes its run of them.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        ends = np.cumsum(sizes[which])
        shift = (np.cumsum(sizes) - sizes)[which] - (ends - sizes[which])
        places = np.repeat(shift, sizes[which])
        places += np.arange(len(places))
        out = np.frombuffer(b"".join(ids), self.dtype)[places]
        bounds = np.concatenate([[0], ends])[edges].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


NO_ID = np.iinfo(np.int64).min


def _bounds(rows: DataFrame, file_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The least key (id, place) of each range but the first, from a sample that is SAMPLE keys a range."""
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // file_bytes))
    keys = rows.select("doc_id", "place").sample(min(1.0, SAMPLE * ranges / max(n, 1)), 42)
    found = sorted((NO_ID if r[0] is None else r[0], r[1]) for r in keys.collect())
    cuts = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []
    return tuple(np.array([c[i] for c in cuts], dtype=np.int64) for i in (0, 1))


def range_of(ids: np.ndarray, places: np.ndarray, bound_ids: np.ndarray, bound_places: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds are no larger than each key."""
    low, high = np.searchsorted(bound_ids, ids, side="left"), np.searchsorted(bound_ids, ids, side="right")
    tied = low < high
    for i in np.unique(ids[tied]).tolist():  # ids that are bounds themselves
        rows = np.flatnonzero(ids == i)
        a, b = low[rows[0]], high[rows[0]]
        low[rows] = a + np.searchsorted(bound_places[a:b], places[rows], side="right")
    return low


def write_files(documents: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, dtype: str = IDS,
                file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents' ids and offsets in order of doc_id; the result is the manifest. Run it once, into a table."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    # Ids that many rows have are cut by the rows' places.
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("place"),
                            F.col("text").cast("string").alias("text"))
    bounds = _bounds(rows, file_bytes)
    width, stop = np.dtype(dtype).itemsize, np.array([end], dtype=dtype).tobytes()

    def encode(batch: pa.RecordBatch) -> list:
        encoder = per_worker(("tokenizers", path, dtype), lambda: Encoder(path, dtype))
        docs, place = batch.column("doc_id"), batch.column("place")
        number = range_of(docs.fill_null(NO_ID).to_numpy(), place.to_numpy(), *bounds)
        return [pa.array(number.astype(np.int32)), docs, place, [x + stop for x in encoder.encode(utf8(batch.column("text")))]]

    coded = arrow_pass(rows, "number int, doc_id bigint, place bigint, ids binary", encode, max_bytes=CODED_BYTES)
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(len(bounds[0]) + 1) // 4))
    dealt = coded.repartition(tasks, "number").sortWithinPartitions("number", F.col("doc_id").asc_nulls_first(), "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        current = None
        for whole in batches:
            numbers = whole.column("number").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if current is None or current.number != numbers[a]:
                        if current is not None:
                            yield current.close()
                        current = _Files(store, root, int(numbers[a]), width)
                    for part in slices(iter([whole.slice(a, b - a)]), "ids"):
                        current.add(part.column("doc_id"), part.column("ids").to_pylist())
        if current is not None:
            yield current.close()

    return dealt.mapInArrow(write, MANIFEST)


class _Files:
    """The files of one range while a task writes them: ids, offsets, and documents."""

    def __init__(self, store: fs.FileSystem, root: str, number: int, width: int):
        store.create_dir(root, recursive=True)
        self.number, self.width, self.n_rows, self.n_tokens = number, width, 0, 0
        self.names = [new_file(root, x) for x in (".ids", ".offsets", ".docs")]
        self.streams = [store.open_output_stream(x, compression=None) for x in self.names]

    def add(self, docs: pa.Array, ids: list[bytes]) -> None:
        lengths = np.array([len(x) // self.width for x in ids], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        self.streams[0].write(b"".join(ids))
        self.streams[1].write(starts.astype(OFFSETS).tobytes())
        # Two numbers a document: whether it has an id, and the id.
        both = docs.is_valid().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy(zero_copy_only=False)
        self.streams[2].write(np.stack(both, axis=1).astype("<i8").tobytes())
        self.n_rows, self.n_tokens = self.n_rows + len(ids), self.n_tokens + int(lengths.sum())

    def close(self) -> pa.RecordBatch:
        self.streams[1].write(np.array([self.n_tokens], dtype=OFFSETS).tobytes())
        for s in self.streams:
            s.close()
        values = [self.number, *self.names, self.n_rows, self.n_tokens]
        kinds = [pa.int32(), *[pa.string()] * 3, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                          names=[x.split()[0] for x in MANIFEST.split(", ")])


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each file's base: the ids in all files before it. One row per file, so one task suffices."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mapped(store: fs.FileSystem, path: str, dtype: str, start: int, count: int) -> np.ndarray:
    """Items of a flat file: memory-mapped where it is a local one, else read by range."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", offset=start * np.dtype(dtype).itemsize, shape=(count,)) if count else np.empty(0, dtype)
    width = np.dtype(dtype).itemsize
    with store.open_input_file(path) as source:
        source.seek(start * width)
        return np.frombuffer(source.read(count * width), dtype=dtype)


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_files(manifest: DataFrame, folder: str, dtype: str = IDS, read_rows: int = READ_ROWS) -> DataFrame:
    """Every document of the files: its id, the ids before it, its number of ids and their checksum."""
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_rows") - 1) / read_rows)))
    pieces = manifest.select("file", "offsets", "ids", "base", "n_rows", piece.alias("piece"))
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism,
                int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["piece"] * read_rows
                n = min(read_rows, row["n_rows"] - at)
                offsets = np.array(mapped(store, row["offsets"], OFFSETS, at, n + 1)).astype(np.int64)
                docs = np.array(mapped(store, row["ids"], "<i8", 2 * at, 2 * n)).reshape(n, 2)
                ids = mapped(store, row["file"], dtype, int(offsets[0]), int(offsets[-1] - offsets[0]))
                edges = (offsets - offsets[0]).tolist()
                sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[:, 1], pa.int64(), mask=docs[:, 0] == 0), pa.array(offsets[:-1] + row["base"], pa.int64()),
                     pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], names=[x.split()[0] for x in READ.split(", ")])

    return pieces.repartition(tasks, "file", "piece").mapInArrow(read, READ)


def round_trip(documents: DataFrame, vocabulary: str | None = None, file_bytes: int = FILE_BYTES,
               read_rows: int = READ_ROWS) -> DataFrame:
    """Write the documents to files in the shared folder and read these back."""
    folder = shared_path(documents.sparkSession, "token-ids")
    manifest = written(write_files(documents, folder, vocabulary, file_bytes=file_bytes), "token-ids-manifest")
    return read_files(with_bases(manifest), folder, read_rows=read_rows)
