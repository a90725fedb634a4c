"""Language identification: held-out accuracy on the given documents, and the defined cases."""

import os
import zlib

import pytest

from textgauge.llm import language

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.keep_identified(docs, language.learn(language.training_rows(docs)))
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(truth)


def test_defined_cases(spark):
    english, german = "the cat sat on the mat and then it ran away. " * 9, "der hund lief über die straße und schlief ein. " * 9
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "12 34 !!", "en", 1), (None, english, None, 1),
             (1, english, "en", 1), (103, german * 500, None, None), (104, "�€", "en", 1), (105, "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102, 104)] == ["und"] * 4
    assert by_id[None].lang_pred == by_id[1].lang_pred == "en" and by_id[103].lang_pred == "de"
    assert by_id[105].lang_pred in ("de", "en") and by_id[105].rejected and not by_id[103].rejected
    kept = language.keep_identified(df, language.learn(language.training_rows(df)))
    assert {r.doc_id for r in kept.collect()} == {*range(40), None, 103}
    bare = df.where("lang is null")
    assert {r.lang_pred for r in language.identify(bare).collect()} == {"und"}
    assert language.identify(df.where("false")).count() == 0


def test_copies_draw_once_and_every_language_is_learned(spark):
    words = {"aa": "sol mar luz pan voz", "bb": "krig haus wolf stein berg", "cc": "zima voda hleb more grad"}
    rows = []
    for lang, line in words.items():
        for i in range(2):
            for _ in range(200):
                rows.append((len(rows), f"{line} {i} " * 30, lang))
    rows += [(len(rows) + i, f"{words['aa']} {i} " * 30, "aa") for i in range(400)]
    rows += [(len(rows) + i, "7" * 3000 + words["bb"], "dd") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(df, dictionary_bytes=1500)
    assert sorted(model) == ["aa", "bb", "cc", "dd"] and all(0 < len(x) <= 1500 for x in model.values())
    assert model["dd"] == (words["bb"] + "\n").encode()
    for lang in ("bb", "cc"):  # both texts, each once
        assert len({x for x in model[lang].split(b"\n") if x}) == 2 and model[lang].count(b"\n") <= 2
    assert language.learn(df.union(df), dictionary_bytes=1500) == model
    # The smallest hashes until the dictionary is full.
    distinct = df.where("lang = 'aa'").selectExpr("text", "shiftrightunsigned(xxhash64(text), 1) draw").distinct()
    best = [r.text[:1024].lower() for r in distinct.orderBy("draw").collect()]
    assert model["aa"] == "".join(x + "\n" for x in best).encode()[:1500]


def test_every_label_is_learned(spark):
    """105 labels: each has a dictionary and can be predicted, within one budget for all."""
    def line(k):
        return " ".join(f"{a}{chr(97 + k % 26)}{b}{chr(97 + k // 26)}{a}" for a in "bdfgk" for b in "aeiou")

    rows = [(200 * i + k, line(k), f"l{k:03}") for k in range(105) for i in range(1 + (k < 100))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(df)
    assert sorted(model) == [f"l{k:03}" for k in range(105)]
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert all(got[k] == f"l{k:03}" for k in range(105))
    small = language.learn(df, total_bytes=105 * 40)
    assert len(small) == 105 and all(len(x) == 40 for x in small.values())
    assert len(language.learn(df, total_bytes=50)) == 105


def test_numerals_are_no_letters(spark):
    rows = [(0, "sol mar luz pan voz " * 20, "aa"), (1, "krig haus wolf stein " * 20, "bb"), (3, "\u00b2\u2167 12 !!", None), (4, "\u00e9", None)]
    rows += [(i, t, lang) for i, (_, t, lang) in enumerate(rows[:2], 5)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[3] == "und" and got[4] != "und"
