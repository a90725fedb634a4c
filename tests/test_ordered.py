"""Sliced ordered operators against brute force, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.operators import ordered


def skewed(n, span, seed):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(span), i)
            for i in range(n)]


def test_rank_and_running_count(spark):
    rows = skewed(600, 300, 1)
    df = spark.createDataFrame(rows, "k string, p long, i long").withColumn(
        "chunk", ordered.slice_of("p", 17))
    got = ordered.rank_in_key(df, ["k"], "chunk", [F.col("p"), F.col("i")], "r", "n")
    flagged = ordered.running_count(df, ["k"], "chunk", [F.col("p"), F.col("i")],
                                    F.col("i") % 3 == 0, "c")
    counts = {r["i"]: r["c"] for r in flagged.collect()}
    seen: dict = {}
    for k, p, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen.setdefault(k, []).append(i)
    for r in got.collect():
        order = seen[r["k"]]
        assert r["r"] == order.index(r["i"]) + 1 and r["n"] == len(order)
        assert counts[r["i"]] == sum(x % 3 == 0 for x in order[:r["r"]])


def test_asof_and_next(spark):
    rows = skewed(300, 1000, 2)
    marks = [("hot", 5 * j * j, f"v{j}") for j in range(12)] + [("a", 400, "x")]
    left = spark.createDataFrame(rows, "k string, p long, i long").select(
        "k", F.timestamp_micros(F.col("p")).alias("ts"), "i")
    right = spark.createDataFrame(marks, "k string, p long, v string").select(
        "k", F.timestamp_micros(F.col("p")).alias("ts"), "v")
    got = {r["i"]: r["v"] for r in ordered.asof(left, right, ["k"], "ts", "v", 37).collect()}
    assert len(got) == len(rows)
    for k, p, i in rows:
        past = [(q, v) for kk, q, v in marks if kk == k and q <= p]
        assert got[i] == (max(past)[1] if past else None)
    points = spark.createDataFrame([(k, q, q) for k, q, _ in marks], "k string, at long, v long")
    probes = spark.createDataFrame(rows, "k string, at long, i long")
    got = {r["i"]: r["_next"] for r in ordered.next_at_or_after(
        points, probes, ["k"], "at", "v", 37).collect()}
    for k, p, i in rows:
        later = [q for kk, q, _ in marks if kk == k and q >= p]
        assert got[i] == (min(later) if later else None)


def test_mark_chain_over_many_slices(spark):
    rng = random.Random(3)
    pos = sorted({rng.randrange(20_000) for _ in range(900)})
    nodes = []
    for i, p in enumerate(pos):
        later = pos[i + 1:i + 1 + rng.randrange(1, 30)]
        nodes.append(("hot", p, rng.choice(later) if later else None))
    nodes += [("b", 1, 5), ("b", 5, None), ("b", 3, 5)]
    df = spark.createDataFrame(nodes, "k string, pos long, nxt long")
    starts = spark.createDataFrame([("hot", pos[2]), ("b", 1)], "k string, pos long")
    nxt = {(k, p): n for k, p, n in nodes}
    want = set()
    for at in (("hot", pos[2]), ("b", 1)):
        while at[1] is not None:
            want.add(at)
            at = (at[0], nxt[at])
    for width in (250, 10**9):
        got = ordered.mark_chain(df, starts, "k", width)
        rows = [(r["k"], r["pos"]) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_quantiles_and_profile(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 2.0, 2.0, rng.random() * 9]) for _ in range(1500)]
    df = spark.createDataFrame([(v, float(i % 7)) for i, v in enumerate(values)],
                               "x double, y double")
    got = {r["name"]: r for r in ordered.column_profile(df, ["x", "y"]).collect()}
    for name, data in (("x", values), ("y", [float(i % 7) for i in range(1500)])):
        r = got[name]
        assert np.allclose([r["q25"], r["q50"], r["q75"]], np.quantile(data, [.25, .5, .75]))
        assert np.allclose([r["mean"], r["std"], r["min"], r["max"]],
                           [np.mean(data), np.std(data, ddof=1), min(data), max(data)])
        assert r["count"] == 1500


def test_top_per_key_and_slice_width(spark):
    rows = skewed(500, 400, 5)
    df = spark.createDataFrame(rows, "k string, p long, i long")
    got = ordered.top_per_key(df, ["k"], [F.col("p").desc(), F.col("i")], 5, salts=4)
    want = set()
    for key in {r[0] for r in rows}:
        want |= set(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:5])
    assert {tuple(r) for r in got.collect()} == want
    assert ordered.slice_width(df, ["k"], "p", 10_000, (1000, 100, 10)) == 1000
    assert ordered.slice_width(df, ["k"], "p", 120, (1000, 100, 10)) == 100
    assert ordered.slice_width(df, ["k"], "p", 1, (1000, 100, 10)) == 10


@pytest.mark.parametrize("few", [1, 10, 1_000])
def test_first_n_by_selection(spark, few, monkeypatch):
    """Ties, busy and small keys, null keys and different numbers per key, with passes of few bits."""
    monkeypatch.setattr(ordered, "PASS_BITS", 3)
    rng = random.Random(few)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0, 1, 5, 7, 8, 63, 64, 900, 1023]), i) for i in range(400)]
    rows += [("z", 3, 1000 + i) for i in range(3)]
    wanted = {"a": 37, "b": 0, "c": 10_000, None: 5, "z": 2}
    df = spark.createDataFrame([(k, p, i, wanted[k]) for k, p, i in rows], "k string, p int, i int, n int").repartition(3)
    marked = ordered.first_n(df, ["k"], F.col("p"), [F.col("i").desc()], F.col("n"), bits=10, mark="first", few=few).collect()
    assert len(marked) == len(rows)
    want = {r[2] for k in wanted for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -r[2]))[:wanted[k]]}
    assert {r.i for r in marked if r["first"]} == want
    same = ordered.first_n(df, ["k"], F.col("p"), [F.col("i").desc()], 4, bits=10, few=few).collect()
    want = {r[2] for k in wanted for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -r[2]))[:4]}
    assert {r.i for r in same} == want


def test_slice_width(spark):
    df = spark.createDataFrame([("a", i * 1_000_000) for i in range(100)] + [("b", 5)], "k string, p bigint")
    assert [ordered.slice_width(df, ["k"], "p", n) for n in (100, 99, 60, 59, 1, 0)] == [
        ordered.SLICES[0], 60_000_000, 60_000_000, 1_000_000, 1_000_000, 1_000_000]
    assert ordered.slice_width(df.where("false"), ["k"], "p") == ordered.SLICES[0]
