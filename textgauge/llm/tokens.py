"""Token counts from flat token files by a scan for end-of-document identifiers.

A token file is a run of little-endian integers; each document ends with the end-of-document identifier, and there
is no index. Files are cut into blocks of equal size. Each block is searched by itself with one vectorised
comparison, which gives its number of separators, the tokens before the first and after the last, and the lengths in
between. A prefix scan over the blocks' summaries (in two levels, so that no task sees all blocks of a large file)
then says how many documents ended before each block and how many tokens of an open document reach into it, which
is all that stitching the lengths needs.

Defined cases: a null or empty text is a document of no tokens; a file that does not end with a separator has a last
document with complete = false; empty files and tables have no documents; a file whose size is no multiple of the
token width raises; documents without id or with repeated ids are counted row by row; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_file, open_store, per_worker, shared_path

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50_256
DTYPE = "<u2"
FILE_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 20
#: Blocks in a group of the prefix scan's first level.
SCAN_GROUP = 1024
MANIFEST = "file string, ordinal bigint, doc_id bigint"
SUMMARY = ("file string, block bigint, n_tokens bigint, n_ends bigint, head bigint, tail bigint, inner array<bigint>")


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(documents: DataFrame, folder: str, vocabulary: str | None = None, end: int = END_OF_DOCUMENT,
                      dtype: str = DTYPE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents' tokens; the result says which document is which of its file. Run it once, into a table."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("tiktoken", path), lambda: encoding(path))
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        stop = np.array([end], dtype=dtype).tobytes()
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            names, ordinals = [], []
            for text in batch.column("text"):
                if out is not None and size >= file_bytes:
                    out.close()
                    out = None
                if out is None:
                    name, size, n = new_file(root, ".tokens"), 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = np.array(encoder.encode_ordinary(text.as_py() or ""), dtype=dtype).tobytes() + stop
                out.write(data)
                names.append(name)
                ordinals.append(n)
                size, n = size + len(data), n + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()),
                                              batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(write, MANIFEST)


def search_block(tokens: np.ndarray, end: int) -> tuple[int, int, int, int, np.ndarray]:
    """Tokens, separators, tokens before the first and after the last, and the lengths between them."""
    ends = np.flatnonzero(tokens == end)
    if not len(ends):
        return len(tokens), 0, len(tokens), len(tokens), ends
    return len(tokens), len(ends), int(ends[0]), len(tokens) - int(ends[-1]) - 1, np.diff(ends) - 1


def scan_blocks(files: DataFrame, folder: str, end: int = END_OF_DOCUMENT, dtype: str = DTYPE,
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One summary per block of the files named in column file."""
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            rows = [(f, i) for f, info in zip(names, store.get_file_info(names), strict=True)
                    for i in range(-(-info.size // (block_tokens * width)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.int64())], names=["file", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        for batch in batches:
            for f, b in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with store.open_input_file(f) as source:
                    source.seek(b * block_tokens * width)
                    data = source.read(block_tokens * width)
                if len(data) % width:
                    raise ValueError(f"{f} ends within a token")
                n, ends, head, tail, inner = search_block(np.frombuffer(data, dtype=dtype), end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f]), *(pa.array([x], pa.int64()) for x in (b, n, ends, head, tail)),
                     pa.array([inner], pa.list_(pa.int64()))], names=names)

    blocks = files.select("file").mapInArrow(cut, "file string, block bigint")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(tasks).mapInArrow(scan, SUMMARY)


def stitch(summaries: DataFrame) -> DataFrame:
    """The documents of each file in order: file, ordinal, n_tokens, complete. Summaries are read three times."""
    # Within a group of blocks: documents ended and tokens open before each block. A group is summed up like a block:
    # its tokens since its last separator, or all of them, and whether it has a separator at all.
    narrow = summaries.select("file", "block", "n_tokens", "n_ends", "tail",
                              F.floor(F.col("block") / SCAN_GROUP).alias("part"))
    own = Window.partitionBy("file", "part").orderBy("block")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def scanned(df: DataFrame, at: str, frame) -> DataFrame:
        """at: the order; adds ended and open before each row within the frame's partition."""
        start = F.coalesce(F.sum("n_tokens").over(frame), F.lit(0))
        ended = F.coalesce(F.sum("n_ends").over(frame), F.lit(0))
        df = df.withColumn("start", start).withColumn("ended", ended)
        last = F.when(F.col("n_ends") > 0, F.col("start") + F.col("n_tokens") - F.col("tail"))
        df = df.withColumn("last", last)
        return df.withColumn("open", F.col("start") - F.coalesce(F.max("last").over(frame), F.lit(0))).withColumn(
            "fresh", F.max("last").over(frame).isNotNull())

    local = scanned(narrow, "block", before)
    groups = (local.groupBy("file", "part").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_ends").alias("n_ends"),
        (F.sum("n_tokens") - F.coalesce(F.max("last"), F.lit(0))).alias("tail")))
    over = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned(groups, "part", over).select(
        "file", "part", F.col("ended").alias("ended_before"), F.col("open").alias("open_before"))
    placed = local.select("file", "part", "block", "ended", "open", "fresh").join(carried, ["file", "part"]).select(
        "file", "block", (F.col("ended") + F.col("ended_before")).alias("ended"),
        (F.col("open") + F.when(F.col("fresh"), 0).otherwise(F.col("open_before"))).alias("open"),
        # The last block of a file closes its last document.
        F.col("block").alias("at"))
    last = narrow.groupBy("file").agg(F.max("block").alias("final"))
    rows = summaries.join(placed, ["file", "block"]).join(last, "file")
    lengths = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))).otherwise(
        F.array().cast("array<bigint>"))
    left = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("n_tokens"))
    documents = rows.select("file", "ended", "n_ends", lengths.alias("lengths"),
                            F.when((F.col("block") == F.col("final")) & (left > 0), left).alias("left"))
    whole_ones = documents.select("file", "ended", F.posexplode("lengths").alias("i", "n_tokens")).select(
        "file", (F.col("ended") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    cut_ones = documents.where("left is not null").select(
        "file", (F.col("ended") + F.col("n_ends")).alias("ordinal"), F.col("left").alias("n_tokens"),
        F.lit(False).alias("complete"))
    return whole_ones.union(cut_ones)


def count_tokens(documents: DataFrame, vocabulary: str | None = None, file_bytes: int = FILE_BYTES,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the documents to token files in the shared folder, scan these, and name the documents again."""
    spark = documents.sparkSession
    folder, names, sums = (shared_path(spark, x) for x in ("tokens", "token-names", "token-blocks"))
    write_token_files(documents, folder, vocabulary, file_bytes=file_bytes).write.parquet(names)
    manifest = spark.read.parquet(names)
    scan_blocks(manifest.select("file").distinct(), folder, block_tokens=block_tokens).write.parquet(sums)
    found = stitch(spark.read.parquet(sums))
    return found.join(manifest, ["file", "ordinal"]).select("doc_id", "n_tokens", "complete")
