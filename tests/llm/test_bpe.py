"""Distinct-word BPE against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from textgauge.llm import bpe

CLASSES = bpe._classes()
TRICKY = ["'", "'s", "'ll", "'re", "'d", "'T", "''s", " 's", "don't", "a'ves", " ", "  ", "\n", "\r\n", "\t", " ", " ",
          "\x1c", "\u0085", "x", "É", "ß", "日", "1", "½", "Ⅷ", "!", "#", "_", "́", "😀", "\x00", "ab cd", "  !", " 12"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TRICKY), st.text(max_size=3)), max_size=12))
def test_cut_points_are_those_of_the_pattern(parts):
    text = "".join(parts)
    assert bpe.cut_points(text, CLASSES) == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_against_the_library(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a" * 4000, "the cat's " * 20_000, "".join(TRICKY)]
    texts += ["".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (3, "again", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block string")
    encoder = bpe._encoding(public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for i, t, _ in rows:
        ids = encoder.encode_ordinary(t or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    for size in (bpe.BLOCK_CHARS, 500):
        got = bpe.round_trip(df, block_chars=size).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = bpe.encode(df.where("doc_id is not null"))
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {
        (i, tuple(encoder.encode_ordinary(t or ""))) for i, t, _ in rows if i is not None}
    assert {(r.doc_id, r.text) for r in bpe.decode(encoded).collect()} == {(i, t or "") for i, t, _ in rows if i is not None}
    assert bpe.round_trip(df.where("false")).count() == 0
    broken = spark.createDataFrame([(1, None), (2, [encoder.encode_ordinary("é")[0]] if len(encoder.encode_ordinary("é")) > 1 else [])],
                                   "doc_id bigint, ids array<int>")
    assert bpe.decode(broken).where("doc_id = 1 and text is null").count() == 1


def test_blocks_of_copies_do_not_meet(spark):
    """Blocks with equal lists of words: one block a group, in one partition or several, and right ids."""
    rows = [(i if i % 3 else None, "the same text again", "x") for i in range(300)] + [(i, None, "x") for i in range(300, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block string").coalesce(2)

    def sizes(blocks, answers, path):
        return pa.table({"doc_id": pa.array([blocks.num_rows], pa.int64())})

    found = [r.doc_id for r in bpe._reassemble(df, None, 100, sizes, "doc_id bigint").collect()]
    assert len(found) > 50 and set(found) == {1}
    encoder = bpe._encoding(public_tokenizers.path(bpe.VOCABULARY))
    got = bpe.encode_rows(df, block_chars=100).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(
        ((i, encoder.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
