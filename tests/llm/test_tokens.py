"""Token counts against the tokenizer itself, and stitching against a plain split."""

import random

import numpy as np
import public_tokenizers

from textgauge.llm import tokens
from textgauge.llm.common import open_store, shared_path


def test_counts(spark):
    texts = [None, "", " ", "one two", "日本語 é", "x " * 30_000, "a" * 3000, "<|endoftext|>"] + [f"doc {i} " * (i % 40) for i in range(100)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (3, "one two", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    encoder = tokens.encoding(public_tokenizers.path(tokens.VOCABULARY))
    want = sorted(((i, len(encoder.encode_ordinary(t or "")), True) for i, t, _ in rows), key=str)
    for block in (1 << 20, 64, 1):
        if block == 1:  # every token a block: few documents are enough
            df = df.where("doc_id in (0, 1, 2, 3, 4)")
            want = [w for w in want if w[0] in (0, 1, 2, 3, 4)]
        got = tokens.count_tokens(df, file_bytes=5000, block_tokens=block).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert tokens.count_tokens(df.where("false")).count() == 0


def test_stitching(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SCAN_GROUP", 3)
    rng, folder = random.Random(1), shared_path(spark, "flat")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    want, names = [], []
    for k, size in enumerate([0, 1, 7, 100, 400, 50]):
        data = [9 if rng.random() < (0.02 if k % 2 else 0.3) else 1 for _ in range(size)]
        names.append(f"{root}/{k}")
        with store.open_output_stream(names[-1]) as out:
            out.write(np.array(data, "<u2").tobytes())
        lengths = [len(x) for x in "".join(map(str, data)).split("9")]
        rest = lengths.pop()
        want += [(names[-1], i, n, True) for i, n in enumerate(lengths)] + ([(names[-1], len(lengths), rest, False)] if rest else [])
    files = spark.createDataFrame([(n,) for n in names], "file string")
    for block in (1, 5, 64):
        got = tokens.stitch(tokens.scan_blocks(files, folder, end=9, block_tokens=block)).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
