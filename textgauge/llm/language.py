"""Language identification by compression: the language whose dictionary shortens a text most.

For each language a raw-content zstandard dictionary is made from a bounded sample of labelled texts. A text is
cut into pieces of at most PIECE bytes (all of them, so long texts don't drown the dictionary in their own
repetitions), each piece is compressed with every dictionary, and the language with the smallest total wins.
The saving over the second best, as a share of the text, is the margin; narrow margins are rejected.

Bounds of the sample (documented parameters): DICTIONARY_BYTES of text per language, and TOTAL_BYTES for all, so beyond
100 languages each one's share is smaller; every language has a dictionary. A Python worker holds up to some 0.8 MB of
tables per language, 0.1 MB where there are a thousand. Of a language's distinct texts with letters those with the
smallest hashes fill its dictionary, so copies count once and each language gets text. All else covers all rows.

Defined cases: a null text and one without letters are `und` with score 0; texts of few letters still get the best
language but are marked as rejected if the margin is narrow; ties go to the language that sorts first; without
labelled rows every text is `und`; rows with a null id, repeated rows and further columns pass as they are.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, bounded, newest_per_worker, released, slices

DICTIONARY_BYTES = 96 << 10
TOTAL_BYTES = 100 * DICTIONARY_BYTES
PIECE = 1024
LEVEL = 6
#: Least saving over the second best language: in bytes for each byte of the text, and in bytes.
MARGIN, LEAST_BYTES = 0.002, 1
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"

#: A letter, in Python and for Spark; numerals are none.
LETTERS = r"\p{L}"
LETTER = regex.compile(LETTERS)


def training_rows(documents: DataFrame) -> DataFrame:
    """The labelled rows to learn from: crc32 of the id as text, modulo 4, is not 2."""
    return documents.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(rows: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES,
          total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """A dictionary for every language, of the distinct texts with the smallest hashes.

    It has at most dictionary_bytes, or an equal share of total_bytes if that is less (one byte at least).

    The first pass counts the bytes of each language's distinct texts by the number of bits of their hash, which tells
    up to how many bits they fill the dictionary. The second reads the pieces of these texts, each text once.
    """
    text = F.col("text").cast("string")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), text.alias("text"),
                       F.shiftrightunsigned(F.xxhash64(text), 1).alias("draw"))
    # A piece from a place that the hash chooses stands for a long text; one without letters gives way to the first letter.
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    at = F.when(F.substring("text", at, F.lit(PIECE)).rlike(LETTERS), at).otherwise(F.regexp_instr("text", F.lit(LETTERS)))
    pieces = rows.withColumn("at", at).where("at > 0").select(
        "lang", "draw", F.substring("text", F.col("at"), F.lit(PIECE)).alias("piece"))
    size = F.octet_length("piece") + 1
    texts = pieces.groupBy("lang", "draw").agg(F.max(size).alias("size"))
    bits = F.length(F.bin("draw"))
    counted = texts.groupBy("lang", bits.alias("bits")).agg(F.sum("size").alias("size")).collect()
    if not counted:
        return {}
    names = {r["lang"] for r in counted}
    share = max(1, min(dictionary_bytes, total_bytes // len(names)))
    room, last = dict.fromkeys(names, share), dict.fromkeys(names, 0)
    for r in sorted(counted, key=lambda r: r["bits"]):
        if room[r["lang"]] > 0:
            last[r["lang"]] = (1 << r["bits"]) - 1
            room[r["lang"]] -= r["size"]
    ends = rows.sparkSession.createDataFrame(list(last.items()), "lang string, last bigint")
    drawn = (pieces.join(F.broadcast(ends), "lang").where("draw <= last")
             .groupBy("lang", "draw").agg(F.first("piece").alias("piece")))
    before = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(
        F.col("before") < share).select("lang", "draw", F.substring("piece", 1, share).alias("piece"))
    parts: dict[str, list[bytes]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"])):
        parts.setdefault(r["lang"], []).append((r["piece"].lower() + "\n").encode())
    return {k: b"".join(v)[:share] for k, v in sorted(parts.items())}


def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    """A compressor per language, primed with its dictionary."""
    out = []
    for _, content in model:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False,
                                            write_dict_id=False))
    return out


def _judge(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> tuple[int, float, bool]:
    """The best language's number or -1, its score, and whether the margin is too narrow."""
    if not text or not compressors or not LETTER.search(text):
        return -1, 0.0, True
    data = text.lower().encode("utf-8", "surrogatepass")
    pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors])
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return best, 1.0, False
    saved = int(np.partition(sizes, 1)[1] - sizes[best])
    share = saved / len(data)
    return best, float(share / (share + MARGIN * 10)), bool(saved < LEAST_BYTES or share < MARGIN)


def predict(documents: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1, grows with the margin) and rejected."""
    names = [*model, "und"]
    held = documents.sparkSession.sparkContext.broadcast(tuple(model.items()))

    def work(batch: pa.RecordBatch) -> list:
        compressors = newest_per_worker("languages", held.value, lambda: _compressors(held.value))
        found = [_judge(t, compressors) for t in batch.column("text").to_pylist()]
        return [batch.column("doc_id"), batch.column("held_out"), [names[x[0]] for x in found],
                [x[1] for x in found], [x[2] for x in found]]

    return arrow_pass(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), is_held_out().alias("held_out"),
                                       F.col("text").cast("string").alias("text")), RESULT, work)


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict all rows."""
    return predict(documents, learn(training_rows(documents)))


def keep_identified(documents: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """The rows whose language is clear; all columns stay as they are."""
    held = documents.sparkSession.sparkContext.broadcast(tuple(model.items()))

    def keep(batches):
        compressors = newest_per_worker("languages", held.value, lambda: _compressors(held.value))
        for part in slices(batches):
            bad = [_judge(t, compressors)[2] for t in part.column("text").to_pylist()]
            yield part.filter(pa.array([not x for x in bad], pa.bool_()))

    return bounded(documents).mapInArrow(released(keep), documents.schema)
