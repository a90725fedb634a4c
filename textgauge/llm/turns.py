"""Repair of conversations: the cheapest edits that give a well-formed order of roles.

The turns of a conversation must read, by the first letters of their roles, (s?(ua)+)?: perhaps a system turn, then
user and assistant in turn. Edits are Keep (free), Rerole to user or assistant, Delete, and Insert of an empty user or
assistant turn; blank and repeated turns must be deleted, and a truncated turn that stays costs extra. Of the cheapest
edits those are taken whose letters (the audit) are least in ASCII order.

The search is depth-first branch and bound with an explicit stack. A node is a number of turns read and the state of
the role pattern. One backward pass gives each node's suffix lower bound: the least cost to finish from it, whatever the
audit. Branches are tried in ASCII order and dropped if cost and bound exceed the incumbent's cost, at first the root's
bound, or if the node's dominance table has a prefix that is no worse: as audits come in ascending order, a later prefix
of the same cost is a worse one. Since two audits of a node with the same cost are never a prefix of each other, what
is worse at a node stays worse to the end. The search ends when no branch is left; it visits no node twice, so its work
grows with the turns, even for very long conversations. Repeated patterns of short conversations are solved once in a
task.

Spark brings the turns of a conversation together and orders them; a conversation's structure comes first (a byte a
turn), then its texts, which are read as a stream. Of the longest conversation a task holds some 40 bytes a turn, never
its texts. Repeated turns are found by Spark before.

Defined cases: rows are ordered by turn (nulls first), then role and the SHA-256 of the text; a null conversation id is
a conversation; a null role or text counts as one blank; a conversation all of whose rows are marked dropped has
zeros and an empty audit; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_worker

COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
#: States of the role pattern: nothing yet, behind s, behind u, behind a. Those at which it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: A turn's code: the letter of its role (o: any other), upper case if truncated, x if it must be deleted.
FORCED = "x"
#: Turns up to which solutions are kept for conversations of the same codes, and how many.
SHORT, KEPT = 64, 1 << 16
NEVER = 1 << 60


def suffix_bounds(codes: str) -> list[list[int]]:
    """For each number of turns read and each state the least cost of what follows."""
    out = [[0 if s in FINAL else NEVER for s in range(4)]]
    _close(out[0])
    for code in reversed(codes):
        after = out[-1]
        row = [COST["D"] + x for x in after]
        if code != FORCED:
            extra = TRUNCATED_COST if code.isupper() else 0
            for state in range(4):
                kept = STEP.get(code.lower(), {}).get(state)
                if kept is not None:
                    row[state] = min(row[state], after[kept] + extra)
                row[state] = min(row[state], after[_next(state)] + COST["R"] + extra)
        _close(row)
        out.append(row)
    out.reverse()
    return out


def _next(state: int) -> int:
    """The state behind the user or assistant turn that fits."""
    return ASSISTANT if state == USER else USER


def _close(row: list[int]) -> None:
    """Let insertions lower the bounds of one place."""
    user, assistant = row[USER], row[ASSISTANT]
    row[USER] = min(user, assistant + COST["I"])
    row[ASSISTANT] = min(assistant, user + COST["I"])
    for state in (START, SYSTEM):
        row[state] = min(row[state], row[USER] + COST["I"])


def search(codes: str) -> tuple[int, str]:
    """The least cost of a repair, and its least audit."""
    bounds = suffix_bounds(codes)
    limit, audit = bounds[0][START], None
    seen: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, START, 0, 0, "")]  # turns read, state, cost, letters before, letter
    while stack:
        at, state, cost, depth, letter = stack.pop()
        if cost + bounds[at][state] > limit or cost >= seen.get((at, state), NEVER):
            continue
        seen[at, state] = cost
        del path[depth:]
        if letter:
            path.append(letter)
        depth = len(path)
        if at == len(codes) and state in FINAL:
            if audit is None or cost < limit:
                limit, audit = cost, "".join(path)
            continue
        # Pushed from the last letter to the first, so that the first comes off the stack first.
        if at < len(codes):
            code = codes[at]
            if code != FORCED:
                extra = TRUNCATED_COST if code.isupper() else 0
                kept = STEP.get(code.lower(), {}).get(state)
                stack.append((at + 1, _next(state), cost + COST["R"] + extra, depth, "R"))
                if kept is not None:
                    stack.append((at + 1, kept, cost + extra, depth, "K"))
        stack.append((at, _next(state), cost + COST["I"], depth, "I"))
        if at < len(codes):
            stack.append((at + 1, state, cost + COST["D"], depth, "D"))
    return limit, audit or ""


def solve(codes: str) -> tuple[int, str]:
    """search, which remembers what it found for short conversations."""
    if len(codes) > SHORT:
        return search(codes)
    known = per_worker("repairs", dict)
    if codes not in known:
        if len(known) >= KEPT:
            known.clear()
        known[codes] = search(codes)
    return known[codes]


BLANK = r"\x20\x09-\x0D"


def first_fault(text: Column, repeated: Column) -> Column:
    """blank, duplicate, truncated or null."""
    return (F.when(~text.rlike(f"[^{BLANK}]"), "blank").when(repeated, "duplicate")
            .when(~text.rlike(f"[.!?][{BLANK}]*\\z"), "truncated"))


#: What a task reads of a turn: part 0 is its structure, part 1 its role and text.
ROWS = "conv_id", "part", "turn", "code", "role", "text"
SUMMARY = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")
REPAIRED = "conv_id bigint, position bigint, edit string, role string, text string"
LEGAL = {"su", "ua", "au"}


def _dealt(conversations: DataFrame, dropped: str | None) -> DataFrame:
    """The turns' structure and texts, by conversation and in order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    no_turn = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        blank("role").alias("role"), blank("text").alias("text"), no_turn.alias("dropped")).withColumn(
        "digest", F.sha2("text", 256))
    # A repeated turn is not the first of its role and text: groups of (conversation, role, text), not of conversations.
    order = Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.col("turn").asc_nulls_first())
    fault = first_fault(F.col("text"), F.lit(False))
    narrow = rows.select("conv_id", "turn", "role", "digest", "dropped", fault.alias("fault"))
    repeated = F.row_number().over(order) > 1
    letter = F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("o")
    fault = F.when(F.col("dropped"), "dropped").when(F.col("fault") == "blank", "blank").when(
        repeated, "duplicate").otherwise(F.coalesce("fault", F.lit("")))
    structure = narrow.withColumn("fault", fault).select(
        "conv_id", F.lit(0).alias("part"), "turn", F.concat(letter, F.col("fault")).alias("code"),
        F.col("role"), F.lit(None).cast("string").alias("text"), "digest")
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("part"), "turn", F.lit("").alias("code"), "role", "text", "digest")
    return structure.union(texts).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "digest").select(*ROWS)


class _Conversation:
    """What a task knows of the conversation that it reads."""

    def __init__(self, name: int | None):
        self.name, self.codes, self.last, self.counts = name, bytearray(), "", dict.fromkeys(
            ("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = None
        self.different, self.initial = 0, ""
        self.audit = self.plan = None
        self.digest, self.started, self.cost = hashlib.sha256(), False, 0
        self.at, self.state, self.position = 0, START, 0

    def learn(self, turn: int | None, code: str, role: str) -> None:
        fault = code[1:]
        if fault == "dropped":
            return
        letter, initial = code[0], role[:1]
        if fault:
            self.counts[fault] += 1
        if self.codes and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        self.codes += (FORCED if fault in ("blank", "duplicate") else letter.upper() if fault else letter).encode()
        if turn is not None:
            if turn != self.most:
                self.different += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = solve(self.codes.decode())

    def _put(self, edit: str, role: str, text: str) -> tuple:
        item = f"{role}:{text}".encode()
        self.digest.update(b"\n" + item if self.started else item)
        self.started = True
        self.position += 1
        return self.name, self.position - 1, edit, role, text

    def insertions(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _next(self.state)
            yield self._put("I", ROLE_OF[self.state], "")

    def read(self, role: str, text: str) -> Iterator[tuple]:
        """The turns that this one and the insertions before it become."""
        self.settle()
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = _next(self.state)
            yield self._put(edit, ROLE_OF[self.state], text)
        elif edit == "K":
            self.state = STEP[role[0]][self.state]
            yield self._put(edit, role, text)

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.different
        return (self.name, gaps, *self.counts.values(), self.cost, self.audit, self.digest.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    schema = _SCHEMAS[rows]
    current, out = None, []

    def finish() -> None:
        if current is not None:
            current.settle()
            made = list(current.insertions())
            out.extend(made if rows else [current.summary()])

    def batch_of(items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*items, strict=True), schema, strict=True)],
                                          schema=schema)

    for batch in batches:
        for name, part, turn, code, role, text in zip(*(batch.column(c).to_pylist() for c in ROWS), strict=True):
            if current is None or current.name != name:
                finish()
                current = _Conversation(name)
            if part == 0:
                current.learn(turn, code, role)
            else:
                made = list(current.read(role, text))
                if rows:
                    out.extend(made)
        if out:
            yield batch_of(out)
            out = []
    finish()
    if out:
        yield batch_of(out)


_SCHEMAS = {
    False: pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in SUMMARY.split(", ")]),
    True: pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in REPAIRED.split(", ")]),
}


def repair(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """The repaired turns of conv_id, turn, role, text: conv_id, position, edit, role, text.

    A boolean column may mark rows that are no turns: they only keep their conversation in the report.
    """
    return _dealt(conversations, dropped).mapInArrow(lambda b: _stream(b, True), REPAIRED)


def report(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """Per conversation: gaps in its turns, faults, cost and audit of the repair, and the digest of what it gives."""
    return _dealt(conversations, dropped).mapInArrow(lambda b: _stream(b, False), SUMMARY)
