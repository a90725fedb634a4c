"""Top-k search against brute force."""

import math
import random

from textgauge.llm import vectors


def brute(rows, every, top):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        mine = min(v for i, v in ok if i == q)
        found = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(mine))
        out += [(q, k + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, i) in enumerate(found[:top])]
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(600)]
    rows += [(1000 + i, [1.0] * 20) for i in range(200)]  # ties
    rows += [(2000, [1e15] * 3), (2001, [1e14, -1e15, 3.0]), (2050, []), (2051, []), (None, [0.0] * 20), (2100, None),
             (2101, [None] + [0.0] * 19), (2102, [float("nan")] * 20), (2103, [float("inf")] * 20), (50, [0.1] * 20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    want = brute(rows, 50, 5)
    for block in (4096, 5):
        got = vectors.search(df, query_block=block).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert vectors.search(df.where("false")).count() == 0
    assert vectors.search(df.where("vec_id = 0")).count() == 0
