"""The corpus pipeline against the stages' brute-force versions, on the smallest given tables."""

import hashlib
import os

import public_tokenizers
import pytest

import corpus_pipeline
from textgauge.llm import bpe, language, pii

from . import test_decontaminate, test_neardup

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")
def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    bad = {r.doc_id for r in language.identify(docs).where("rejected").collect()}
    assert len(bad) <= 0.03 * len(texts)
    rows = [(d, t) for d, t in texts.items() if d not in bad]
    rows = [(d, texts[d]) for d, _, component in test_neardup.brute(rows) if d == component]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not test_decontaminate.brute(t, items)[-1]]
    model = pii.default_model()
    rows = [(d, pii.masked(t, spans)) for (d, t), (_, spans) in zip(rows, pii.all_spans([t for _, t in rows], model), strict=True)]
    encoder = bpe._encoding(public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for d, t in rows:
        ids = encoder.encode_ordinary(t)
        want.append((d, ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(want)
    assert 0 < len(want) < len(texts)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")
def test_stages_keep_columns(spark):
    rows = [(1, "the same text " * 9, "en", "s", 126, 1), (1, "the same text " * 9, "en", "s", 126, 1), (2, None, None, None, None, 2),
            (None, "no id but words that are clear", "en", "s", 30, 3), (3, "", "en", "s", 0, 4), (4, "mail a@b.cd now " * 3, "en", "s", 48, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, class int")
    for some in (df, df.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, DATA)
            assert out.columns == df.columns and out.dtypes == df.dtypes
            assert out.count() <= some.count()
        assert corpus_pipeline.encode(spark, some, DATA).count() == some.count()
    assert corpus_pipeline.remove_near_copies(spark, df, DATA).count() == 5
