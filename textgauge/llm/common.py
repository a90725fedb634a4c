"""Shared helpers: tables, Arrow passes in slices of bounded bytes, files named by URI, word bytes."""

from __future__ import annotations

import contextlib
import ctypes
import posixpath
import re
import sys
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from textgauge.session import shared_dir, shuffles_freed  # noqa: F401

SLICE_BYTES = 1 << 20
#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 4 << 20

#: UTF-8 bytes: A-Z to lower case, what is no word character to a blank. Every byte of a character beyond
#: ASCII counts as a word character, so the table is the character class [^\x00-\x2F\x3A-\x60\x7B-\x7F].
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8 bytes; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most max_bytes of that column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0)
        lengths = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(lengths):
            run = np.cumsum(lengths[start:])
            stop = start + max(1, int(np.searchsorted(run, max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python in batches of BATCH_BYTES, unless it has a setting of its own for that.

    By Spark's default a batch has 10,000 rows, and the executor and its worker each hold it more than once.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def arrow_pass(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], list], column: str = "text",
               max_bytes: int = SLICE_BYTES) -> DataFrame:
    """Run work over slices of df; it returns the columns of schema in order, as lists or Arrow arrays."""
    parsed = _parse_datatype_string(schema)
    names, types = parsed.names, to_arrow_schema(parsed).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, max_bytes):
            out = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t)
                   for x, t in zip(work(part), types, strict=True)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return bounded(df).mapInArrow(released(run), schema)


def per_worker(key: Hashable, make: Callable[[], object]):
    """What make gives, made once in each Python worker and kept for the tasks that it runs later."""
    kept = sys.__dict__.setdefault("_textgauge_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def newest_per_worker(key: Hashable, version: Hashable, make: Callable[[], object]):
    """What make gives for this version, kept until the worker is asked for another one: models come and go."""
    kept = sys.__dict__.setdefault("_textgauge_kept", {})
    if key not in kept or kept[key][0] != version:
        kept.pop(key, None)
        kept[key] = version, make()
    return kept[key][1]


def release() -> None:
    """Give free memory back to the system; a worker lives on and else keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every system
        ctypes.CDLL(None).malloc_trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The pass over batches, giving its memory back when the task is through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared folder."""
    root = shared_dir(spark)
    return f"{root if re.match(r'[a-z][a-z0-9+.-]*:', root) else 'file://' + root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: a lost executor costs nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; on a cluster the shared folder is in a store that Arrow can open."""
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """The URI of a file that no other attempt of the task writes."""
    return posixpath.join(folder, f"{uuid.uuid4().hex}{suffix}")
