"""TF-IDF, balancing, training, storage and streamed scoring on small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.operators import balance, kernel, models, scoring, tfidf
from textgauge.sources import io, store
from textgauge.streaming import jobs
from textgauge.streaming.state import places

DOCS = ["Graph tree graph search", "tree search a tree", "the graph of the tree", "", "x y",
        "sort merge sort search tree"]


def grams(text, stop):
    w = [x for x in re.findall(r"\w\w+", text.lower()) if x not in stop]
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_tfidf_against_definition(spark):
    stop = ["the", "of"]
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, t string")
    counts = tfidf.term_counts(df, "id", "t", 3, stop)
    want = {(i, t): n for i, d in enumerate(DOCS) for t, n in Counter(grams(d, stop)).items()}
    assert {(r["id"], r["term"]): r["n"] for r in counts.collect()} == want
    df_of = Counter(t for _, t in want)
    kept = {t for t, n in df_of.items() if 2 <= n <= 0.85 * len(DOCS)}
    vocab = tfidf.vocabulary(counts, len(DOCS), 100)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert idf == pytest.approx({t: math.log((1 + 6) / (1 + df_of[t])) + 1 for t in kept})
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.weights(counts, "id", vocab).collect()}
    raw = {k: (1 + math.log(n)) * idf[k[1]] for k, n in want.items() if k[1] in kept}
    norm = {i: math.sqrt(sum(w * w for (j, _), w in raw.items() if j == i)) for i in range(6)}
    assert got == pytest.approx({k: w / norm[k[0]] for k, w in raw.items()})


def test_text_vocabulary_and_weights_without_all_terms(spark, monkeypatch):
    """From texts: as from all term counts, in which rows of one key, or without one, share their norm; few terms are made."""
    made = random.Random(5)
    texts = [" ".join(made.choices(["w%d" % i for i in range(60)], [1 / (i + 1) for i in range(60)], k=80)) for _ in range(40)]
    texts += [" ".join(f"rare{i}x{j}" for j in range(50)) for i in range(20)] + [None, "", "w0", "Ünï w1 w1"]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string").cache()
    counts = tfidf.term_counts(df, "id", "t", 3, ["w3"])
    terms = counts.select("term").distinct().count()
    sizes = []
    whole = tfidf._term_totals
    monkeypatch.setattr(tfidf, "_term_totals", lambda *a: sizes.append((t := whole(*a)).count()) or t)
    for size in (20, 10_000):
        want = tfidf.vocabulary(counts, len(rows), size)
        got = tfidf.text_vocabulary(df, "t", len(rows), 3, ["w3"], size)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        a = {(r["id"], r["term"], round(r["weight"], 9)) for r in tfidf.weights(counts, "id", want).collect()}
        b = {(r["id"], r["term"], round(r["weight"], 9)) for r in tfidf.text_weights(df, "id", "t", got, 3, ["w3"]).collect()}
        assert a == b
    assert sizes[0] < terms / 10


def test_text_vocabulary_takes_more_buckets_where_limits_drop_the_fullest(spark):
    """The most frequent terms are in too many rows, or in too few."""
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(f"{common} " + " ".join([f"own{i}"] * 30) + f" kept{i // 2}",) for i in range(12)]
    df = spark.createDataFrame(rows, "t string")
    got = tfidf.text_vocabulary(df, "t", len(rows), 1, [], 2)
    assert sorted((r["term"], r["df"], r["total"]) for r in got.collect()) == [("kept0", 2, 2), ("kept1", 2, 2)]


def test_words_in_slices(monkeypatch):
    import pyarrow as pa

    from textgauge.operators import grams as counted

    rows = [["a", "b", "a"], [], ["a", "b"], ["c"] * 5, ["b", "a", "b", "c"]]
    monkeypatch.setattr(counted, "SLICE_WORDS", 4)
    got = Counter()
    for part in counted.slices(pa.array([["z"], *rows]).slice(1)):
        for terms, term, row, n in part.row_counts(3, np.ones(counted.BUCKETS, bool)):
            got.update({(part.first + r, terms[t]): k for t, r, k in zip(term, row, n, strict=True)})
    assert got == Counter((i, " ".join(r[j:j + n])) for i, r in enumerate(rows) for n in (1, 2, 3) for j in range(len(r) - n + 1))


def test_nearest_is_exact_over_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    cls = ["big" if i % 4 else "small" for i in range(60)]
    df = spark.createDataFrame([(i, cls[i], x[i].tolist()) for i in range(60)],
                               "id long, c string, x array<double>")
    got: dict = {}
    for r in balance.nearest(df, "id", "c", "x", 3, block_rows=10).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(60):
        d = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(60)
                   if j != i and cls[j] == cls[i])[:3]
        assert [n for _, n in sorted(got[i])] == [j for _, j in d]


def test_oversample_balances_between_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i < 30 else "b" if i < 42 else "c", [rng.random(), rng.random() + i // 30],
             float(i)) for i in range(47)]
    df = spark.createDataFrame(rows, "id long, c string, x array<double>, s double")
    out = balance.oversample(df, "id", "c", "x", k=3, score="s").collect()
    assert Counter(r["c"] for r in out) == {"a": 30, "b": 30, "c": 30}
    for r in out:
        mine = [q for q in rows if q[1] == r["c"]]
        assert min(q[3] for q in mine) <= r["s"] <= max(q[3] for q in mine)
        for k in range(2):
            assert min(q[2][k] for q in mine) <= r["x"][k] <= max(q[2][k] for q in mine)
    assert balance.balance(df, "id", "c", "x", k=3, score="s").count() == 90


def test_redrawn_scores_come_from_the_class(spark):
    rows = [(i, "ab"[i % 2], float(i % 2 * 100 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, c string, s double")
    balanced = df.withColumn("row_id", F.col("id"))
    out = balance.redraw_scores(balanced, df, "id", "c", "s").collect()
    assert len(out) == 40
    pool = {c: {r[2] for r in rows if r[1] == c} for c in "ab"}
    assert all(r["s"] in pool[r["c"]] for r in out)


TINY = models.Sizes(max_features=60, selected=30, ngrams=2, lr_iterations=20, forest_trees=3,
                    forest_depth=3, boost_rounds=2, boost_depth=2, score_trees=3, score_depth=3)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(9)
    vocab = {"easy": ["print", "sum", "count", "word"], "medium": ["graph", "path", "tree", "walk"],
             "hard": ["suffix", "convex", "flow", "cut"]}
    rows = []
    for i in range(90):
        c = ["easy", "easy", "medium", "hard"][i % 4]
        words = [rng.choice(vocab[c] + ["the", "of", "given"]) for _ in range(14)]
        rows.append((i, " ".join(words), "in", None, c, {"easy": 2., "medium": 5., "hard": 8.}[c]
                     + rng.random()))
    df = spark.createDataFrame(
        rows, "problem_id long, description string, input_desc string, output_desc string, "
              "problem_class string, problem_score double")
    return scoring.train(df, TINY)


def test_training_learns_and_answers_are_shaped(spark, trained):
    model, split = trained
    preds = scoring.test_predictions(model, split).collect()
    assert len(preds) == 18
    assert sum(r["actual"] == r["predicted"] for r in preds) >= 14
    assert all(1 / 3 - 1e-9 <= r["confidence"] <= 1 for r in preds)
    req = spark.createDataFrame([("r1", "suffix convex flow", "", ""), ("r2", " ", "", ""),
                                 ("r3", None, "x", "y")],
                                "request_id string, description string, input_desc string, "
                                "output_desc string")
    answers, bad = scoring.answer_requests(req, model)
    a = answers.collect()
    assert [r["request_id"] for r in a] == ["r1"] and bad.count() == 2
    assert 1 <= a[0]["score"] <= 10 and a[0]["features"]["wordCount"] == 3
    both, _ = scoring.answer_requests(req.where("request_id = 'r1'"), model, "structured")
    b = both.first()
    assert (b["class"], b["score"], b["features"]) == (a[0]["class"], a[0]["score"], a[0]["features"])
    assert b["input"]["description_length"] == len("suffix convex flow")


def test_saved_model_scores_alike_and_must_be_whole(spark, trained, fresh):
    model, split = trained
    store.save_model(model, spark, f"{fresh}/model")
    again = store.load_model(spark, f"{fresh}/model")
    rows = split.where("split = 'test'")

    def scores(m):
        return {r["problem_id"]: (r["cls"], round(r["raw_score"], 9), round(r["confidence_raw"], 9))
                for r in m.score(rows, "combined_text").collect()}
    assert scores(model) == scores(again)
    manifest = spark.read.schema(store.MANIFEST).json(f"{fresh}/model/manifest")
    manifest.where("part != 'scorer'").write.json(f"{fresh}/part/manifest")
    with pytest.raises(ValueError, match="scorer"):
        store.load_model(spark, f"{fresh}/part")


def test_streamed_scoring_uses_its_cache(spark, trained, fresh):
    model, _ = trained
    cols = "request_id string, description string, input_desc string, output_desc string"
    for part in ([("a", "graph path tree", "", ""), ("b", "graph path tree", "", ""), ("x", "", "", "")],
                 [("c", "graph path tree", "", ""), ("d", "print the sum", "", "")]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").json(f"{fresh}/in")
    stream = io.stream_requests(spark, f"{fresh}/in", 1)
    checkpoint, cache_path, out = places(spark, "t")
    jobs.scored_requests(stream, model, cache_path, checkpoint, out,
                         "2024-01-01 00:00:00").awaitTermination()
    rows = {r["request_id"]: r for r in spark.read.parquet(f"{out}/answers").collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert len({(rows[k]["cls"], rows[k]["score"]) for k in "abc"}) == 1
    late = [rows[k]["cached"] for k in "abcd" if rows[k]["batch"] == 1]
    assert sorted(late) in ([False, True], [True, True, False], [False, False, True])
    assert spark.read.parquet(cache_path).count() == 2
    assert spark.read.parquet(f"{out}/rejected").count() == 1


def test_sources_round_trip(spark, fresh):
    rows = [("t", "d", "i", "o", "easy", 2.5), ("t", "d", "i", "o", "easy", 2.5),
            (None, "d2", None, None, "hard", 8.0)]
    spark.createDataFrame(rows, "title string, description string, input_description string, "
                          "output_description string, problem_class string, problem_score double"
                          ).write.json(f"{fresh}/problems")
    got = io.read_problems(spark, f"{fresh}/problems")
    assert {"input_desc", "output_desc", "problem_id", "problem_score_scaled"} <= set(got.columns)
    assert got.select("problem_id").distinct().count() == 3
    logs = spark.createDataFrame(
        [("INFO", 'say "hi", then go', {"a": 'x,"y"'}), ("ERROR", "two", {})],
        "level string, message string, metadata map<string,string>")
    io.export_logs(logs, f"{fresh}/csv", "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{fresh}/csv")
    assert {tuple(r) for r in back.collect()} == {
        ("INFO", 'say "hi", then go', '{"a":"x,\\"y\\""}'), ("ERROR", "two", "{}")}
    io.export_logs(logs, f"{fresh}/json")
    assert spark.read.schema(logs.schema).json(f"{fresh}/json").count() == 2
    with pytest.raises(ValueError):
        io.export_logs(logs, f"{fresh}/xml", "xml")
    metrics = spark.createDataFrame([("m1", 1.0), ("m2", 2.0)], "model_name string, value double")
    io.export_telemetry({"metrics": metrics}, f"{fresh}/export", "m1")
    assert [r["value"] for r in spark.read.json(f"{fresh}/export/metrics").collect()] == [1.0]
    io.export_tables({"alerts": metrics, "rules": metrics}, f"{fresh}/tables")
    assert spark.read.json(f"{fresh}/tables/rules").count() == 2
    for v, w in ((1, 0.3), (2, 0.6)):
        io.save_weights(spark.createDataFrame([("a", w)], "model_name string, weight double"),
                        f"{fresh}/w", v)
    assert io.load_weights(spark, f"{fresh}/w").first()["weight"] == 0.6
    assert io.load_weights(spark, f"{fresh}/w", 1).first()["weight"] == 0.3
    backup = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)],
                                   "data_type string, content string, created_at int")
    io.append_backup(backup, f"{fresh}/b")
    from textgauge.operators.cache import newest_backup
    assert newest_backup(spark.read.parquet(f"{fresh}/b")).first()["content"] == "new"


def test_neighbours_on_equal_lengths_rule_out_blocks(spark):
    """Unit vectors in clusters: exact neighbours, and most block pairs are never compared."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 8)), 40, axis=0) * 4 + rng.normal(size=(480, 8)) / 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id int, c string, x array<double>")
    told = {}
    got = {}
    for r in balance.nearest(df, "id", "c", "x", 4, block_rows=20, told=told).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(480):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[[j for j in range(480) if j == i or j % 2 != i % 2]] = np.inf
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(480), d))[:4].tolist()
    assert told["compared"] < 0.4 * told["pairs"]


def test_neighbour_blocks_grow_with_the_class(spark):
    """A class of many rows is cut into a bounded number of blocks, however small they were asked for."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 8))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id int, c string, x array<double>")
    told = {}
    got = {}
    for r in balance.nearest(df, "id", "c", "x", 3, block_rows=5, told=told).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert told["pairs"] <= (balance.PIVOTS + balance.BLOCKS) ** 2
    for i in range(0, 2000, 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [n for _, n in sorted(got[i])] == np.argsort(d, kind="stable")[:3].tolist()


def test_kernels_of_blocks_are_those_of_pairs(spark):
    """Blocks of queries meet blocks of rows: every pair once, its kernel exact, also for a key that repeats or has no vector."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 6)) / 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (50, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    out = kernel.compared(df, df.where("id % 10 = 7 or id = 50"), "id", "x", 6, 0.2, block_rows=4).collect()
    vectors = [(i, None if v is None else np.array(v)) for i, v in rows]
    want = Counter((i, j, None if a is None or b is None else round(math.exp(-0.2 * ((a - b) ** 2).sum()), 9))
                   for i, a in vectors if i % 10 == 7 or i == 50 for j, b in vectors)
    assert Counter((r["query_id"], r["id"], None if r["kernel"] is None else round(r["kernel"], 9)) for r in out) == want
    assert all(abs(r["made"] - r["kernel"]) < 0.15 for r in out if r["kernel"] is not None)
