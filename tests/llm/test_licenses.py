"""License rules: stated phrases against brute force, the rules' own samples, and suppression."""

import re
from re import _parser

import pytest

from textgauge.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROW = "doc_id bigint, text string, labels string"


def samples(pattern):
    """A few words for a pattern: the first and last of all alternatives, options left out and taken."""
    def walk(tokens, take):
        out = ""
        for op, av in tokens:
            op = str(op)
            if op == "LITERAL":
                out += chr(av)
            elif op == "IN":
                out += chr(av[-1 if take else 0][1])
            elif op == "BRANCH":
                out += walk(av[1][-1 if take else 0], take)
            elif op == "SUBPATTERN":
                out += walk(av[3], take)
            elif op == "MAX_REPEAT":
                out += walk(av[2], take) * (av[1] if take else av[0])
        return out

    return {walk(_parser.parse(pattern), take) for take in (False, True)}


def test_rules_can_be_found():
    rules = licenses.rules()
    assert len(rules) >= 300 and [r[0] for r in rules] == sorted(r[0] for r in rules)
    for _, _, label, key, rx in rules:
        for text in samples(rx):
            assert re.fullmatch(rx.replace("(?<= )", "").replace("(?= )", ""), text), (label, text)
            assert any(re.search(licenses.KEY_WORD, w) for w in text.split()), (label, text)
            assert len(text.split()) <= licenses.REACH + 1 and key in f" {text} ", (label, text)


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


CASES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "under cc--by\n\nNC-sa 4.0": "cc-by-nc,cc-by-nc-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
    "a BSD 3-Clause License": "bsd-3",
    "see creativecommons.org/licenses/by": "",
    "https://opensource.org/licenses/MIT": "mit",
    "Der Hund geht mit dem license Mann": "",
    "dedicated to the public domain": "public-domain",
    "CC0": "cc0",
    "éunder the mit license": "mit",
    "under the mit licenseé": "",
    "x licensed under the terms of the ISC license " + "and cc by nc " * 40: "cc-by-nc,isc",
}


def test_against_brute_force(spark):
    texts = [None, "", " ", "...", "the domain", "under THE mit\x00license", "w " * 30_000 + "under the MIT license. " * 300 + "é" * 5000,
             "apache license version 2 under the mit license cc by nc cc by nc", "İ under the mit lıcense K", *CASES]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "CC BY-NC", "x"), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, ROW)
    got = licenses.scan(df).collect()
    key = lambda r: str(r[:6])
    want = [(i, *brute(t)) for i, t, _ in rows]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        if t in CASES:
            assert by_id[i].labels == CASES[t], t
        assert 0 <= by_id[i].score <= 1 and (by_id[i].score > 0) == bool(by_id[i].labels)
    assert licenses.scan(df.where("false")).count() == 0


def test_plan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "cc by nc", "x")], ROW))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    with pytest.raises(Exception, match="text"):
        licenses.scan(spark.range(1))
