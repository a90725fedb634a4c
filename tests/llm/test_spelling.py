"""Spelling variants against brute force."""

import random

import duckdb
import pytest

from textgauge.llm import queries, spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    rows = {}
    for w, n in counts.items():
        others = [(-m, x) for x, m in counts.items() if near(w, x)]
        best = min(others, default=(0, None))
        form = best[1] if best[1] is not None and -best[0] >= ratio * n else None
        rows[w] = [form, n, len(others), -best[0] if form is not None else None]
    out = set()
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.add((w, form, root, n, n_near, form_n))
    return out


def variants(seed, letters, sizes):
    rng = random.Random(seed)
    words = set()
    for _ in range(25):
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        for _ in range(12):
            words.add(w)
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]) or "a"
    return {w: rng.choice([1, 2, 3, 10, 20, 31, 100, 310, 3100, 40_000]) for w in words}


@pytest.mark.parametrize("seed,letters,sizes", [(1, "ab", (1, 2, 3, 4, 5, 7)), (2, "abcé", (6, 7, 8, 9)), (3, "xyñ÷ÿ", (7, 11, 16, 21))])
def test_near_words_and_forms(spark, seed, letters, sizes):
    counts = variants(seed, letters, sizes)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    pairs = {(r.a, r.b) for r in spelling.near_words(df).collect()}
    want = {(a, b) for a in counts for b in counts if near(a, b) and (len(a), a) < (len(b), b)}
    assert pairs == want and len(want) > 50
    got = spelling.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == brute(counts) and len(got) == len(counts)


def test_long_chains(spark):
    counts = {"a" * 7 + "b" * i: 3 * 10 ** i for i in range(9)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = {r.word: r for r in spelling.group(df).collect()}
    assert all(r.root == "a" * 7 + "b" * 8 for r in rows.values())
    assert rows["a" * 7].form == "aaaaaaab" and rows["a" * 7].n_near == 1 and rows["a" * 7].form_n == 30


def documents(n=60):
    rng = random.Random(9)
    base = ["Wörterbuch", "wörterbuch", "ABCDEFGH", "mistake", "mistakes", "ÀÉÎõü÷ÿ", "longerword", "short", "miztakes"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(80))) for i in range(n)]
    rows += [(None, "mistake nothing nothing"), (3, None), (3, ""), (7, "x" * 5000 + " " + "mistakes, " * 900), (7, rows[7][1]),
             (-5, "one-two_threefour5sixseven")]
    return rows


def test_query_against_sql_and_empty(spark, fresh):
    """Nulls, repeated ids and rows, long texts, columns with clashing names, and an empty table."""
    schema = "doc_id bigint, text string, word string, n bigint, `key` string"
    for name, rows in (("full", documents()), ("none", [])):
        df = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], schema)
        df.repartition(3).write.parquet(f"{fresh}/{name}/documents.parquet")
        got = queries.op11_asymmetric_chunk_spelling(spark, f"{fresh}/{name}")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{fresh}/{name}/documents.parquet/*.parquet'")
        want = {tuple(r) for r in con.execute(queries.OP11_SQL).fetchall()}
        assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
        assert bool(want) == (name == "full")


def test_no_table_of_words_is_broadcast(spark):
    """Files of some MB look small enough for the driver, but hold millions of keys."""
    words = spelling.written(spark.createDataFrame([(w, n) for w, n in variants(4, "abcé", (6, 7, 8, 9)).items()], "word string, n bigint"), "words")
    rows = spelling.group(words)
    for df in (spelling.near_words(words), rows, spelling.roots(rows)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
