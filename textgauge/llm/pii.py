"""Personal data: stated patterns, and a linear-chain conditional random field over word shapes.

The field reads each line as a chain of words. A word's shape is the set of character kinds in it, its length, its
number of digits, whether it is long hexadecimal, and whether it is one of a few key words; the shapes of the
neighbours count too. Weights come from maximum likelihood with L2 on a small labelled table (`training_table`),
fitted on the driver in a few seconds; lines of a slice are decoded together by Viterbi, one numpy step per word position.

Lines in which no word can gain from any label are plain without decoding: a word's gain is bounded by the largest
weights of its own shape and its neighbours', plus twice the best a change of label can earn, so this is exact.

Spans of the field are added where they don't overlap a stated one; stated ones always stay.

Defined cases: a null or empty text has no spans; places are code points, ends exclusive; repeated rows and rows
without id are reported each; an empty table gives an empty result; further columns are ignored, or kept by
`redact`, in which overlapping spans are replaced together and a null text stays null.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, bounded, released, slices

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "id", "secret"]
LABELS = ["other", *KINDS]
RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

# The stated patterns, and what a match must fulfil.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are tried from their first digit only; from a later one they'd fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign the local part is read backwards, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the stated kinds."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text)
                     if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
        out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Word shapes.

DIGITS, LOWERS, UPPERS, BEYOND = 1, 2, 4, 8
SIGNS = ["@", ".", "-", "+", "=", "\"'", "()", "/_:"]
N_BITS = 4 + len(SIGNS) + 1
LENGTHS = np.array([2, 3, 4, 6, 9, 13, 17, 25, 41])
COUNTS = np.array([1, 3, 4, 5, 9, 10, 13, 16, 17, 20])
#: Key words, in lower case, of each group.
KEY_WORDS = [["token", "password", "passwd", "secret", "key", "api_key", "apikey", "password:", "token:", "secret:", "key:", "api_key:"],
             ["phone", "tel", "call", "mobile", "fax", "phone:", "tel:", "tel.", "fax:", "mobile:"],
             ["ssn", "ssn:", "iban", "iban:", "passport", "passport:"], ["="]]
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _byte_bits() -> np.ndarray:
    out = np.full(256, 1 << (N_BITS - 1), dtype=np.uint16)
    out[48:58], out[97:123], out[65:91], out[128:] = DIGITS, LOWERS, UPPERS, BEYOND
    for i, signs in enumerate(SIGNS):
        out[[ord(c) for c in signs]] = 1 << (4 + i)
    out[BLANK] = 0
    return out


BITS = _byte_bits()
HEX = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdefABCDEF"])


class Shapes(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    line: np.ndarray  # number of each word's line
    bits: np.ndarray
    length: np.ndarray
    count: np.ndarray
    hexed: np.ndarray
    luhn: np.ndarray
    key: np.ndarray


def shapes(data: bytes) -> Shapes:
    """The words of lines in UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    blank = BLANK[raw]
    edge = np.diff((~blank).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Shapes(*[none] * 9)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    bits = np.bitwise_or.reduceat(BITS[raw], starts).astype(np.int64)
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw < 58), dtype=np.int32)])
    count = digits[ends] - digits[starts]
    size = ends - starts
    hexed, checked, key = (np.zeros(len(starts), np.int64) for _ in range(3))
    for i in np.flatnonzero((size >= 16) & (count >= 3)).tolist():
        hexed[i] = int(HEX[raw[starts[i]:ends[i]]].sum() >= 16)
    for i in np.flatnonzero((count >= 13) & (count <= 19)).tolist():
        checked[i] = int(luhn(_digits(data[starts[i]:ends[i]].decode("utf-8", "replace"))))
    # Key words: by length and first letter, then by comparison.
    words = {w.encode(): k + 1 for k, group in enumerate(KEY_WORDS) for w in group}
    heads = np.zeros(256, dtype=bool)
    heads[[w[0] for w in words]] = True
    heads[[w.upper()[0] for w in words]] = True
    near = np.zeros(len(starts), dtype=bool)  # key words count beside words with digits only
    odd = np.flatnonzero(count > 0)
    for step in (-3, -2, -1, 1):
        near[np.clip(odd + step, 0, len(starts) - 1)] = True
    for i in np.flatnonzero(near & heads[raw[starts]] & (size <= 10)).tolist():
        key[i] = words.get(data[starts[i]:ends[i]].lower(), 0)
    return Shapes(starts, ends, line, bits, np.searchsorted(LENGTHS, size, side="right"),
                  np.searchsorted(COUNTS, count, side="right"), hexed, checked, key)


#: Features of a word and of each neighbour: name in Shapes, number of values (bits count one by one).
OWN = [("bits", N_BITS), ("length", len(LENGTHS) + 1), ("count", len(COUNTS) + 1), ("hexed", 2), ("luhn", 2), ("key", len(KEY_WORDS) + 1)]
NEAR = [("bits", N_BITS), ("count", len(COUNTS) + 1), ("key", len(KEY_WORDS) + 1)]
PLACES = [(0, OWN), (-1, NEAR), (1, NEAR), (-2, [("key", len(KEY_WORDS) + 1)])]


class Model(NamedTuple):
    tables: list[tuple[int, str, np.ndarray]]  # step, feature, weights by value and label
    edge: dict[int, np.ndarray]  # weights where there is no neighbour
    moves: np.ndarray  # weights by label and next label


def _bit_rows(weights: np.ndarray) -> np.ndarray:
    """Weights of each set of bits, from those of the bits."""
    sets = (np.arange(1 << N_BITS)[:, None] >> np.arange(N_BITS)) & 1
    return sets @ weights


def _moved(s: Shapes, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The word step places on, and whether it is in the same line."""
    n = len(s.starts)
    at = np.clip(np.arange(n) + step, 0, max(n - 1, 0))
    return at, (s.line[at] == s.line) & (at == np.arange(n) + step)


def scores(s: Shapes, model: Model) -> np.ndarray:
    """Each word's score for each label."""
    out = np.zeros((len(s.starts), len(LABELS)))
    moved = {step: _moved(s, step) for step, _ in PLACES}
    for step, name, weights in model.tables:
        at, inside = moved[step]
        values = getattr(s, name)[at]
        out += weights[values] if step == 0 else np.where(inside[:, None], weights[values], 0)
    for step, weights in model.edge.items():
        out[~moved[step][1]] += weights
    return out


def _design(s: Shapes) -> np.ndarray:
    """The same features as a matrix, for training."""
    columns = []
    for step, features in PLACES:
        at, inside = _moved(s, step)
        for name, size in features:
            values = getattr(s, name)[at]
            hot = ((values[:, None] >> np.arange(size)) & 1) if name == "bits" else (values[:, None] == np.arange(size))
            columns.append(hot * inside[:, None])
        if step:
            columns.append(~inside[:, None])
    return np.concatenate(columns, axis=1).astype(float)


def _assemble(weights: np.ndarray, moves: np.ndarray) -> Model:
    tables, edge, at = [], {}, 0
    for step, features in PLACES:
        for name, size in features:
            part = weights[at:at + size]
            tables.append((step, name, _bit_rows(part) if name == "bits" else part))
            at += size
        if step:
            edge[step] = weights[at]
            at += 1
    return Model(tables, edge, moves)


def training_table(seed: int = 11, rounds: int = 10) -> list[list[tuple[str, str]]]:
    """Labelled lines: patterns of words and labels, filled with made-up values of the right shape."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

    def word() -> str:
        w = pick(letters + "éüñ", rng.randint(1, 12))
        return rng.choice([w, w, w, w.capitalize(), w.upper(), w + ".", w + ",", w + "!!", w + "$$$", "|", w + "###", f'"{w}"', f"({w})", w + "-" + w])

    def card(valid: bool) -> str:
        head = pick(digits, 15)
        good = next(c for c in digits if luhn(head + c))
        return head + (good if valid else rng.choice([c for c in digits if c != good]))

    def end(x: str) -> str:
        return x + rng.choice(["", "", "", ".", ",", "!!", "***"])

    values = {
        "EMAIL": lambda: f"{pick(letters, rng.randint(2, 9))}.{pick(digits, 2)}@{pick(letters, 5)}{rng.choice(['', '3'])}.{pick(letters, 7)}.com",
        "IP": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "CARD": lambda: card(True), "NOCARD": lambda: card(False),
        "HEX": lambda: f'"{pick(hexes, rng.choice([32, 40, 64]))}"', "BAREHEX": lambda: pick(hexes, rng.choice([32, 40])),
        "AKIA": lambda: "AKIA" + pick(letters.upper() + digits, 16), "PASS": lambda: "password=" + pick(hexes, rng.randint(10, 20)),
        "AREA": lambda: f"({pick(digits, 3)})", "LOCAL": lambda: f"{pick(digits, 3)}-{pick(digits, 4)}", "PLUS": lambda: "+" + str(rng.randint(1, 99)),
        "DASHED": lambda: f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", "SSN": lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        "IBAN": lambda: rng.choice(["DE", "FR", "ES"]) + pick(digits, 20), "YEAR": lambda: str(rng.randint(1000, 2099)), "INT": lambda: pick(digits, rng.randint(1, 8)),
        "VERSION": lambda: rng.choice(["2.0", "4.0.", "3.", "1.2.3", "v2", "3.14", "12,345"]), "DATE": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        "CODE": lambda: rng.choice(["a=b", "x==1", "i+1", "f(x)", "a1", "b2b", "covid-19", "h2o", "12:30", "50%", "$40", "#12", "1st", "3x", "/tmp/a1", "http://a.b/c?d=1", "x_1", "=", "+", "-", "c++"]),
    }
    patterns = [
        "", "w YEAR", "INT w INT", "VERSION", "w CODE w CODE", "DATE", "NOCARD", "w = INT", "key = CODE", "w token w", "call w at INT", "version VERSION", "w = w",
        "EMAIL/email", "w EMAIL/email w", "mail EMAIL/email", "IP/ip", "w IP/ip", "CARD/card", "card CARD/card", "PLUS/phone AREA/phone LOCAL/phone",
        "w PLUS/phone AREA/phone LOCAL/phone w", "call AREA/phone LOCAL/phone", "AREA/phone LOCAL/phone", "tel DASHED/phone", "phone DASHED/phone", "DASHED/phone",
        "SSN/id", "ssn SSN/id", "w SSN/id w", "IBAN/id", "iban IBAN/id", "token = HEX/secret", "secret = HEX/secret", "key: BAREHEX/secret", "w HEX/secret",
        "BAREHEX/secret w", "AKIA/secret", "w AKIA/secret w", "PASS/secret", "w PASS/secret w", "api_key = HEX/secret", "TOKEN = HEX/secret",
    ]
    out = []
    for _ in range(rounds):
        for p in patterns:
            row = [(word(), "other") for _ in range(rng.randint(0, 5))]
            for x in p.split():
                name, _, label = x.partition("/")
                text = values[name]() if name in values else word() if name == "w" else x
                text = text.upper() if rng.random() < 0.1 and label in ("", "secret", "email") else text
                row.append((end(text) if label and not name.startswith(("PLUS", "AREA")) else text, label or "other"))
            out.append(row + [(word(), "other") for _ in range(rng.randint(0, 5))])
    return [r for r in out if r]


def train(rows: list[list[tuple[str, str]]], l2: float = 0.02, steps: int = 120, rate: float = 0.15) -> Model:
    """Maximum likelihood by Adam; sums over label sequences by forward and backward passes over all lines at once."""
    s = shapes("\n".join(" ".join(w for w, _ in r) for r in rows).encode())
    x = _design(s)
    y = np.array([LABELS.index(k) for r in rows for _, k in r])
    k, n = len(LABELS), len(rows)
    sizes = np.array([len(r) for r in rows])
    longest = int(sizes.max())
    place = np.full((n, longest), -1)
    place[np.arange(longest) < sizes[:, None]] = np.arange(len(y))
    real = place >= 0
    weights, moves = np.zeros((x.shape[1], k)), np.zeros((k, k))
    gold_moves = np.zeros((k, k))
    pair = real[:, 1:]
    np.add.at(gold_moves, (y[place[:, :-1][pair]], y[place[:, 1:][pair]]), 1)
    gold = np.zeros((len(y), k))
    gold[np.arange(len(y)), y] = 1
    state = [np.zeros_like(p) for p in (weights, moves, weights, moves)]

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = np.where(real[:, :, None], (x @ weights)[place], 0)
        forward, backward = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(real[:, t, None], total(forward[:, t - 1, :, None] + moves, 1) + e[:, t], forward[:, t - 1])
        whole = total(forward[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(real[:, t + 1, None], total(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0)
        marginal = np.exp(forward + backward - whole[:, None, None])
        both = np.zeros((k, k))
        for t in range(1, longest):
            on = real[:, t]
            joint = forward[on, t - 1, :, None] + moves + (e[on, t] + backward[on, t])[:, None, :] - whole[on, None, None]
            both += np.exp(joint).sum(axis=0)
        grads = [x.T @ (marginal[real] - gold) / n + l2 * weights / 10, (both - gold_moves) / n + l2 * moves / 10]
        for i, (p, g) in enumerate(zip((weights, moves), grads, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
            p -= rate * (state[i] / (1 - 0.9 ** step)) / (np.sqrt(state[i + 2] / (1 - 0.99 ** step)) + 1e-8)
    return _assemble(weights, moves)


@functools.cache
def default_model() -> Model:
    """The model of the given training table; fitted once in a driver."""
    return train(training_table())


def hopeless(s: Shapes, model: Model) -> np.ndarray:
    """For each word, whether even the best labels around it could not make a label pay."""
    gain = np.full(len(s.starts), 2 * max(0.0, float((model.moves - model.moves[0, 0]).max())))
    moved = {step: _moved(s, step) for step, _ in PLACES}
    for step, name, weights in model.tables:
        most = (weights[:, 1:] - weights[:, :1]).max(axis=1)
        at, inside = moved[step]
        values = most[getattr(s, name)[at]]
        gain += values if step == 0 else np.where(inside, values, 0)
    for step, weights in model.edge.items():
        gain[~moved[step][1]] += (weights[1:] - weights[0]).max()
    return gain < 0


def viterbi(e: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of chains that stand one after the other in e."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    back = np.zeros(e.shape, dtype=np.int8)
    best = e[starts].copy()
    final = np.zeros(len(sizes), dtype=np.int64)
    for t in range(1, int(sizes[0])):
        on = int(np.searchsorted(-sizes, -t, side="left"))  # the chains longer than t come first
        reach = best[:on, :, None] + moves
        came = reach.argmax(axis=1)
        back[starts[:on] + t] = came
        best[:on] = np.take_along_axis(reach, came[:, None, :], axis=1)[:, 0] + e[starts[:on] + t]
    final = best.argmax(axis=1)
    out = np.zeros(len(e), dtype=np.int64)
    for t in range(int(sizes[0]) - 1, -1, -1):
        on = int(np.searchsorted(-sizes, -t, side="left"))
        out[starts[:on] + t] = final[:on]
        if t:
            final[:on] = back[starts[:on] + t, final[:on]]
    return out


EDGES = "\"'.,;:!?[]{}<>$%&*#|="


def field_spans(texts: list[bytes], model: Model) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text: kind, start and end in bytes."""
    data = b"\n".join(texts)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    s = shapes(data)
    if not len(s.starts):
        return out
    first = np.flatnonzero(np.concatenate([[True], s.line[1:] != s.line[:-1]]))
    sizes = np.diff(first, append=len(s.line))
    open_lines = ~np.logical_and.reduceat(hopeless(s, model), first)
    if not open_lines.any():
        return out
    chosen = np.repeat(open_lines, sizes)
    part = Shapes(*(x[chosen] for x in s))
    labels = viterbi(scores(part, model), sizes[open_lines], model.moves)
    hit = np.flatnonzero(labels)
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    i = 0
    while i < len(hit):
        j = i
        while (j + 1 < len(hit) and hit[j + 1] == hit[j] + 1 and labels[hit[j + 1]] == labels[hit[i]]
               and part.line[hit[j + 1]] == part.line[hit[i]]):
            j += 1
        a, b = int(part.starts[hit[i]]), int(part.ends[hit[j]])
        piece = data[a:b].decode()
        if LABELS[labels[hit[i]]] == "secret" and "=" in piece.rstrip(EDGES):
            a += len(piece[:piece.rindex("=", 0, len(piece.rstrip(EDGES))) + 1].encode())
            piece = data[a:b].decode()
        lead = len(piece) - len(piece.lstrip(EDGES))
        a, b = a + len(piece[:lead].encode()), b - len(piece[len(piece.rstrip(EDGES)):].encode())
        if a < b:
            text = int(np.searchsorted(offsets, a, side="right")) - 1
            out[text].append((LABELS[labels[hit[i]]], a - int(offsets[text]), b - int(offsets[text])))
        i = j + 1
    return out


def all_spans(texts: list[str], model: Model) -> Iterator[tuple[dict, list[tuple[str, int, int]]]]:
    """Per text the stated spans by kind, and all spans by kind and place, in code points."""
    encoded = [t.encode() for t in texts]
    for text, data, found in zip(texts, encoded, field_spans(encoded, model), strict=True):
        base = base_spans(text)
        spans = [(k, a, b) for k in BASE_KINDS for a, b in base[k]]
        if found:
            taken = sorted((a, b) for _, a, b in spans)
            for kind, a, b in found:
                a = len(data[:a].decode()) if len(data) > len(text) else a
                b = len(data[:b].decode()) if len(data) > len(text) else b
                if not any(x < b and a < y for x, y in taken):
                    spans.append((kind, a, b))
        yield base, sorted(set(spans), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of spans of each stated kind, their digest, and all spans."""
    model = documents.sparkSession.sparkContext.broadcast(default_model())

    def work(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        digests, joined = [], []
        for base, spans in all_spans(texts, model.value):
            for k, column in zip(BASE_KINDS, counts, strict=True):
                column.append(len(base[k]))
            own = [(k, a, b) for k in BASE_KINDS for a, b in base[k]]
            digests.append(hashlib.sha256(_joined(own).encode()).hexdigest())
            joined.append(_joined(spans))
        return [batch.column("doc_id"), *counts, digests, joined]

    return arrow_pass(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                       F.col("text").cast("string").alias("text")), RESULT, work)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """The documents with all spans replaced by their kind; a column n_chars follows the new text."""
    model = documents.sparkSession.sparkContext.broadcast(default_model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            found = all_spans([t or "" for t in texts], model.value)
            new = [t if t is None or not spans else masked(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(part.columns)
            columns[part.schema.get_field_index("text")] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = bounded(documents).mapInArrow(released(work), documents.schema)
    if "n_chars" not in documents.columns:
        return out
    size = F.length("text").cast(documents.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
