"""Wu-Manber decontamination against a brute-force reading of the definition."""

import hashlib
import random
import re

from textgauge.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, item_id string, source string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n and name else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit)


def cases():
    rng = random.Random(5)
    vocabulary = ["a", "ab", "b", "Éa", "x9", "the", "then", "日本", "naïve", "z"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 11, 14, 30]))) for i in range(1, 12)]
    items += [(3, say(12)), (None, say(12)), (20, None), (21, ""), (22, "..."), (30, "long " * 40)]
    docs = [None, "", " \n", "the", "A" * 5000, "ab " * 20000, "x\0y", "LONG--long " * 12]
    for _ in range(60):
        body = [say(rng.randint(0, 60))]
        for _, t in rng.sample(items, 2):
            body.append(re.sub(" ", lambda m: rng.choice([" ", " - ", "\n", "\0"]), (t or "").upper()))
        docs.append(rng.choice(["", "! "]) + " ".join(body))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    rows = [(i, t, "c", "s") for i, t in enumerate(docs)] + [(None, docs[-1], "c", "s"), (0, docs[0], "c", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(((i, *brute(t, items)) for i, t, _, _ in rows), key=str)
    for size in (decontaminate.CHUNK_BYTES, 60):
        got = decontaminate.find_contamination(df, bench, chunk_bytes=size).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    clean = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert clean == {w[0] for w in want if not w[-1]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    row = decontaminate.find_contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.find_contamination(docs.where("false"), none).count() == 0
