"""Repair of conversations against an enumeration of all edits, and its parts."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from textgauge.llm import queries, turns

BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(BLANK)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit) and what it gives, of all ways to edit rows of (role, text)."""
    found = faults(rows)
    best = None
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for f in found]
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, more in enumerate(inserted):
                cost, audit, out = cost + 2 * len(more), audit + "I" * len(more), out + [(r, "") for r in more]
                if i < len(rows):
                    e, (role, text) = edits[i], rows[i]
                    if e == "D":
                        cost, audit = cost + 3, audit + "D"
                        continue
                    cost += (found[i] == "truncated") + (0 if e == "K" else 2)
                    audit += "K" if e == "K" else "R"
                    out = [*out, (role if e == "K" else e, text)]
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = cost, audit, out
    return best


ROLES = ["user", "assistant", "system", "agent", " ", "", "tool", "User"]
TEXTS = ["Yes.", "No?", "cut off", "", " \n", "same!", "same!", "more. \t", "a.b"]


def conversation(rng, n):
    usual = rng.random() < 0.5
    return [(ROLES[(i + rng.randrange(2) * (rng.random() < 0.3)) % 2] if usual else rng.choice(ROLES), rng.choice(TEXTS)) for i in range(n)]


def test_search_against_enumeration():
    rng = random.Random(3)
    for n in [0, 1, 1, 1, 2, 2, 2] * 8 + [3] * 25:
        rows = conversation(rng, n)
        codes = "".join("x" if f in ("blank", "duplicate") else (r[:1] if r[:1] in tuple("sua") else "o").upper() if f == "truncated"
                        else r[:1] if r[:1] in tuple("sua") else "o" for (r, _), f in zip(rows, faults(rows), strict=True))
        assert turns.search(codes) == brute(rows)[:2], rows


def test_search_is_linear_on_long_conversations():
    rng = random.Random(4)
    codes = "".join(rng.choice("suaoSUAOx") for _ in range(60_000))
    cost, audit = turns.search(codes)
    assert cost == turns.suffix_bounds(codes)[0][turns.START]
    assert len(audit) - audit.count("I") == len(codes)


def expected(rows):
    """Rows of (turn, role, text) of one conversation, without damage: its report."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    at = [t for t, _, _ in rows if t is not None]
    plain = [(r, x) for _, r, x in rows]
    cost, audit, out = brute(plain)
    f = faults(plain)
    initials = [r[:1] for r, _ in plain]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal,
            cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()), out


def test_report_and_repair(spark):
    rng = random.Random(5)
    conversations = {c: [(rng.choice([None, 0, 1, 2, 5, 9]), *r) for r in conversation(rng, rng.randrange(1, 4))] for c in range(40)}
    conversations[None] = [(1, None, "Hi."), (2, "assistant", None), (None, "user", "A")]
    rows = [(c, t, r, x, "p", 7) for c, xs in conversations.items() for t, r, x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string, code int").repartition(5)
    want = {c: expected(xs) for c, xs in conversations.items()}
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(df).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    made = {}
    for r in sorted(turns.repair(df).collect(), key=lambda r: r.position):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert made == {c: w[1] for c, w in want.items() if w[1]}


def test_dropped_rows_and_empty(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, gone boolean"
    df = spark.createDataFrame([(1, 0, "user", "A.", True), (2, 0, "user", "A.", False), (2, 3, "user", "A.", True)], schema)
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(df, dropped="gone").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:A.\nassistant:").hexdigest())}
    none = spark.createDataFrame([], schema)
    assert turns.report(none).count() == 0 and turns.repair(none).count() == 0


def test_long_conversation_streams(spark):
    """One conversation of many turns and one long text: still one row, its faults counted by Spark."""
    df = spark.range(30_000).selectExpr(
        "1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
        "CASE WHEN id = 77 THEN repeat('long ', 200000) ELSE concat('t', id div 4, '.') END AS text").repartition(4)
    row = turns.report(df).collect()
    assert len(row) == 1 and row[0].truncated == 1 and row[0].duplicate == 14_999 and row[0].audit.count("D") >= 14_999


@pytest.mark.parametrize("rows", [
    [(c, t, r, x) for c in (None, 1, 2, 3) for t, r, x in ((None, "user", "A."), (0, "system", "S."), (1, "user", None), (1, "user", "B"),
                                                           (2, "assistant", "C?"), (2, "assistant", "C?"), (4, None, "D! "), (5, "u", "\n"))],
    []])
def test_query_against_sql(spark, fresh, rows):
    """The damage and the repair on nulls, ties and repeated rows; on an empty table; with columns of clashing names."""
    df = spark.createDataFrame([(*r, 5, "h") for r in rows], "conv_id bigint, turn bigint, role string, text string, fate int, gone string")
    df.write.parquet(f"{fresh}/conversations.parquet")
    got = queries.op12_branch_and_bound_turns(spark, fresh)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{fresh}/conversations.parquet/*.parquet'")
    want = con.execute(queries.op12_sql()).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
