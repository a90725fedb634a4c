"""What a worker and a session keep."""

import random
import sys
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from textgauge.llm import common, language, neardup, pii


def shuffle_files(spark):
    return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()


def test_a_worker_keeps_one_language_model(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog " * 3) for i in range(40)], "doc_id long, text string")
    for word in ("one", "two", "three"):
        language.predict(docs.repartition(4), {"en": f"the quick {word} fox".encode() * 9, "de": b"der schnelle fuchs " * 9}).collect()

    def kept(batches):
        for _ in batches:
            found = [k for k in sys.__dict__.get("_textgauge_kept", {}) if "languages" in (k, k[0])]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], names=["n"])

    assert max(r["n"] for r in spark.range(40).repartition(4).mapInArrow(kept, "n long").collect()) == 1


def test_shuffle_files_of_intermediate_results_go_with_their_job(spark):
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    before = shuffle_files(spark)
    cut, written = neardup.cut(df), neardup._written(df, "counts")
    assert shuffle_files(spark) <= before
    assert cut.count() == written.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_batches_to_workers_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    rows = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    try:
        spark.conf.unset(name)
        pii.redact(rows)
        found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 20_000_000 and max(found) < 6 << 20
        spark.conf.set(name, "7m")  # a session's own setting stays
        assert common.bounded(rows) is rows and spark.conf.get(name) == "7m"
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def test_a_slice_of_texts_takes_little_memory():
    """What the field holds for the words of a slice, in numpy."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) + f" call +1 (555) 010-{i:04d}" for i in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 4 << 20
    model = pii.default_model()
    tracemalloc.start()
    for part in common.slices(iter([batch])):
        assert sum(len(spans) for _, spans in pii.all_spans(part.column("text").to_pylist(), model)) >= part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20  # 63 MB when written, 253 MB by slices of 4 MB
