"""The Jaccard join against brute force, and its parts."""

import random
import re

import numpy as np
import pytest

from textgauge.llm import neardup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def cases(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    passage = say(60)
    texts = [None, "", " \t\n", "one", "one two", "One  TWO", "a b c d e", "a b c d e f", "\x0b\x0c", "x" * 70_000]
    for size in (4, 6, 9, 13, 25, 60, 150, 400):
        for _ in range(6):
            base = say(size)
            for _ in range(rng.randint(1, 6)):
                other = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    other[rng.randrange(size)] = f"w{rng.randint(0, 400)}"
                texts.append(rng.choice([" ", "  ", "\n"]).join(other + say(rng.randint(0, size // 8))))
    for _ in range(25):
        texts.append(" ".join(say(rng.randint(0, 40)) + passage + say(rng.randint(0, 10))))
    texts += [texts[40]] * 15
    chain = say(300)
    texts += [" ".join(chain[i * 8:i * 8 + 120]) for i in range(20)]
    rng.shuffle(texts)
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (7, texts[50]), (7, "q r s t u v")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = cases(seed)
    if seed == 2:  # small bounds, so that every path is taken
        for name, value in (("BUSY", 3), ("HELD", 500), ("CHUNK", 4), ("CHUNK_BYTES", 4000), ("FLUSH", 3000), ("LEAF", 4), ("FANOUT", 2)):
            monkeypatch.setattr(neardup, name, value)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id bigint, text string, class string").repartition(3)
    got = neardup.join(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = neardup.keep_one(df)
    want = {(d, t) for d, t in rows if d is None} | {
        (d, n) for d, n, c in brute(rows) if c is not None and d == c}
    rest = kept.collect()
    assert kept.columns == df.columns
    assert {(r.doc_id, r.text) if r.doc_id is None else (r.doc_id, len(shingles(r.text))) for r in rest} == want
    assert len(rest) == len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.join(df).count() == 0 and neardup.keep_one(df).count() == 0


def test_cells_meet():
    """Sets at the limit always share a cell, whatever their sizes."""
    rng = np.random.default_rng(4)
    for n in [*range(4, 60), 97, 200, 311, 640, 1500]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for cut in range(0, n // 5 + 1, max(1, n // 25)):
                more = rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1)).astype(np.uint64)
                b = np.unique(np.concatenate([a[cut:], more]))
                if neardup._linked(a, b) and len(b) >= 4:
                    assert np.intersect1d(neardup.cells_of(a), neardup.cells_of(b)).size


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, rng.integers(4, 400)).astype(np.uint64) * np.uint64(2) for _ in range(120)]
    base += [rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) for n in (990, 1010, 1030, 40_000)]
    near = [np.where(rng.random(len(b)) < 0.06, rng.integers(0, 1 << 63, len(b)).astype(np.uint64), b)[:int(len(b) * 0.99) + 1]
            for b in base]
    sets = [np.unique(x) for x in [*base, *near, np.zeros(0, np.uint64), np.full(300, 5, np.uint64)]]
    sets[-1] = np.arange(300, dtype=np.uint64)  # all in one group: counts beyond one byte
    sizes = np.array([len(x) for x in sets])
    fine = neardup.points_of([neardup.point_of(x) for x in sets], sizes)
    assert fine.shape[1] == 256 and (fine.sum(axis=1) == sizes).all()
    bound = np.array([np.minimum(f, fine).astype(np.int64).sum(axis=1) for f in fine])
    total = sizes[:, None] + sizes[None]
    ok = (9 * bound >= 4 * total) & (5 * sizes[:, None] >= 4 * sizes[None]) & (4 * sizes[:, None] <= 5 * sizes[None])
    want = {(i, j) for i, j in zip(*np.nonzero(ok), strict=True) if i < j}
    assert len(want) > 50
    assert {(min(p), max(p)) for p in neardup.tree_pairs(sizes, fine, np.arange(len(sizes)))} == want


def test_trees_give_joining_links_only(spark, monkeypatch):
    """750 texts near the limit: all components are right, and no more links leave the trees than they have members."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(200)]
    rows = []
    for i in range(750):
        other = list(base)
        for _ in range(3):
            other[rng.randrange(200)] = f"v{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(other)))
    counts = {}

    def counted(own, sets):
        own, links = own.persist(), made(own, sets).persist()
        counts["links"], counts["members"] = links.count(), own.select("lead", "class").distinct().count()
        counts["classes"], counts["entries"] = own.select("class").distinct().count(), own.count()
        return links

    made = neardup._tree_links
    monkeypatch.setattr(neardup, "_tree_links", counted)
    got = neardup.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert counts["links"] <= counts["members"]
    print(counts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200, 202: 200}


def test_keep_one_leaves_the_texts_of_rows_that_stay_where_they_are(spark):
    """Rows without copies go through no join: only texts of documents that lose a row are shuffled."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(400)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[7]), (7, texts[7]), (None, texts[8]), (9, texts[10]), (300, None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
        size = lambda: sum(f.length() for f in _files(disk))
        start = size()
        got = kept.collect()
        wrote = size() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(i, t) for i, t in enumerate(texts) if i != 10] + [(None, texts[8]), (9, texts[10]), (300, None)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert wrote < 0.3 * sum(map(len, texts))


def _files(disk):
    files = disk.getAllFiles()
    return [files.apply(i) for i in range(files.size())]
