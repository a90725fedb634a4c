"""Text features against a plain-Python reading of the same definitions."""

import random
import re

from pyspark.sql import functions as F

from textgauge.functions import lexicons as lx
from textgauge.functions import profiles, shaping, text

EDGES = [
    None, "", "   ", " ", "a\tb\n\nc", "é dfs é", "édfs", "dfs. bfs, dp!", "O(n) o(1) O()",
    "1 ≤ n ≤ 10 and 2 ≤ m ≤ 30", "1 ≤ n\n≤ 10", "the test: one case, another case; multiple test",
    "Segment Tree, binary search and BINARY  SEARCH tree", "graph_tree graph-tree graph tree",
    "∑ √ π ≤ + - * / = < >", "maximum minimumaximum optimal best", "x\x1cy\x85z",
    "sort sorts sorted sort", "depth first breadth  first", "İstanbul limit",
    "wrong   answer. time limit exceeded! is it? non-trivial nontrivial", "time time limit limit",
    "input format output format example sample t test case",
]


def words_of(t):
    return t.split()


def normal(t, expansions):
    if not t:
        return ""
    t = re.sub(r"\s+", " ", t.lower())
    for short, long in expansions.items():
        t = re.sub(rf"\b{short}\b", long, t)
    return t.strip()


def core(t):
    t = normal(t, lx.SHORT_EXPANSIONS)
    w = words_of(t)

    def n(pattern, flags=0):
        return len(re.findall(pattern, t, flags))

    out = {"text_len": len(t), "word_count": len(w)}
    for name, terms in lx.CORE_WORDS.items():
        out[name] = n(r"\b(?:" + "|".join(terms) + r")\b")
    out["basic_math"] = n(r"[+\-*/=<>]")
    out["advanced_math"] = n("[∑∏∫∂∆√π∞≤≥]")
    out["complexity_notation"] = n(r"o\([^)]+\)", re.I)
    out["constraints"] = n(r"constraint|limit|\d+\s*≤.*≤\s*\d+")
    out["optimization"] = n("minimum|maximum|optimal|best")
    out["multiple_cases"] = n("test.*case|multiple.*test")
    out["vocabulary_richness"] = len(set(w)) / len(w) if w else 0
    out["avg_word_length"] = sum(map(len, w)) / len(w) if w else 0
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["graph", "tree", "dfs", "dp", "test", "case", "multiple", "limit", " ", "  ", "\n", ".",
             "≤", "3", "o(", ")", "sort", "binary", "search", "é", "best", "+", "segment", "time",
             " ", "string", "format", "input", "t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_core_profile_matches_definition(spark):
    rows = list(enumerate(EDGES + random_texts(400, 5)))
    df = profiles.core_profile(spark.createDataFrame(rows, "id long, t string"), "t")
    for r in df.collect():
        want = core(r["t"])
        got = {c: r[c] for c in profiles.CORE_FEATURES}
        for c, v in want.items():
            assert abs(got[c] - v) < 1e-9, (r["t"], c, got[c], v)


def wide_counts(t):
    t = normal(t, lx.FULL_EXPANSIONS)
    w = words_of(t)
    out = {}
    for name, (weight, terms) in lx.TIERS.items():
        out[name] = weight * sum(len(re.findall(rf"\b{p}\b", t)) for p in terms)
    for name, terms in lx.WIDE_WORDS.items():
        out[name] = len(re.findall(r"\b(?:" + "|".join(terms) + r")\b", t))
    out["competitive_terms"] = len(re.findall(r"\b(?:" + "|".join(lx.COMPETITIVE_TERMS) + r")\b", t))
    out["time_complexity_mentions"] = 4.0 * len(
        re.findall("time.*complexity|running.*time|time.*limit", t))
    out["constraint_patterns"] = 2.0 * len(
        re.findall(r"constraint|limit|bound|\d+\s*≤.*≤\s*\d+|1\s*≤.*≤\s*10\^\d+", t))
    out["io_complexity"] = (1.5 * len(re.findall("input.*format|output.*format", t))
                            + len(re.findall("test.*case|multiple.*test|t.*test.*case", t))
                            + 0.5 * len(re.findall("example|sample", t)))
    s = [x for x in re.split(r"[.!?]+", t) if x.strip()]
    out["sentence_count"] = len(s)
    out["avg_sentence_length"] = len(w) / len(s) if s and w else 0
    return out


def test_wide_profile_matches_definition(spark):
    rows = list(enumerate(EDGES + random_texts(200, 6)))
    df = profiles.wide_profile(spark.createDataFrame(rows, "id long, t string"), "t")
    assert df.columns[2:] == profiles.WIDE_FEATURES and len(profiles.WIDE_FEATURES) == 30
    for r in df.collect():
        for c, v in wide_counts(r["t"]).items():
            assert abs(r[c] - v) < 1e-9, (r["t"], c, r[c], v)


def test_literal_wide_profile_counts_no_words(spark):
    df = spark.createDataFrame([("Dynamic programming on a graph, O(n) time limit",)], "t string")
    r = profiles.wide_profile(df, "t", literal=True).first()
    zero = [*lx.TIERS, *lx.WIDE_WORDS, "mathematical_functions", "big_o_notation",
            "total_algorithm_score", "competitive_terms"]
    assert all(r[c] == 0 for c in zero)
    assert r["time_complexity_mentions"] == 4.0 and r["constraint_patterns"] == 2.0


def test_preview_profile(spark):
    rows = [("Graph graphs: DP é dp_x (binary search)!",), ("",), (None,), ("a b cc cc",)]
    got = profiles.preview_profile(spark.createDataFrame(rows, "t string"), "t").collect()
    t = rows[0][0]
    assert got[0]["length"] == len(t)
    assert got[0]["keywords"] == 4
    assert got[0]["math_symbols"] == 3
    assert got[1]["lexical_diversity"] == 0 and got[2]["length"] == 0
    assert got[3]["lexical_diversity"] == 0.5


def test_combine_keeps_inner_spaces(spark):
    rows = [("a", "b", "c"), ("a", "", "c"), ("", "", ""), (None, "Input", None), (" x", None, "y\n")]
    df = spark.createDataFrame(rows, "d string, i string, o string")
    got = [r[0] for r in df.select(text.combine(F.col("d"), F.col("i"), F.col("o"))).collect()]
    assert got == [f"{d or ''} {i or ''} {o or ''}".strip() for d, i, o in rows]


def test_overlapping_list_falls_back_to_alternation(spark):
    df = spark.createDataFrame([("of the of the the",)], "t string")
    marked = text.mark_words(F.col("t"))
    n = df.select(text.count_listed(F.col("t"), marked, ["of the", "the"])).first()[0]
    assert n == len(re.findall(r"\b(?:of the|the)\b", "of the of the the"))


def test_served_fields(spark):
    df = spark.createDataFrame([(0.2, 0.5501), (12.0, 0.55), (5.55, 0.9)], "s double, c double")
    got = df.select(shaping.served_score(F.col("s")), shaping.served_confidence(F.col("c")),
                    shaping.is_reliable(F.col("c")), shaping.score_band(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        (1.0, 0.55, True, "easy"), (10.0, 0.55, False, "hard"), (5.6, 0.9, True, "medium")]


def test_expansion_of_plain_words_without_regular_expressions(spark):
    """Literals between marks: as the patterns, also for texts with marks of their own; the plan has one pattern for words."""
    from textgauge.functions.text import CLOSE, OPEN, bounded

    some = {"dp": "dynamic programming", "bit": "a dp", "es": "es ist", "x_1": "x"}
    rows = ["dp dp,dp edp dpe es_ es x_1 (x_1) Ées esÉ bit", "", None, f"{OPEN}dp{CLOSE} {OPEN}{OPEN} \ufdd2!{CLOSE}dp\ufdd2\"# es\ufdd2",
            "\ufdd2\ufdd2# dp \ufdd2" + CLOSE, "no such word", "٣dp dp٣ dp\u0301"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    old = F.col("t")
    for short, long in some.items():
        old = F.regexp_replace(old, bounded([short]), long)
    out = df.select(text.expand(F.col("t"), some).alias("a"), old.alias("b"))
    assert all(r["a"] == r["b"] for r in out.collect())
    plan = df.select(text.expand(F.col("t"), some).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1
    odd = {"c.t": "cat", "a b": "$0!"}
    assert df.select(text.expand(F.lit("cut a b"), odd).alias("a")).first()["a"] == "cat a b!"
