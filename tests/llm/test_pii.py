"""Personal data: stated patterns against the plain expressions, the field on unseen lines, and masking."""

import hashlib
import itertools
import random
import re

import numpy as np

from textgauge.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def check(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and check(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]}


def test_stated_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "x.y+z@m-1.de.", "@", "a@", "@b.c", "a@b", "a@b..c", "a@@b.c", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "0001.0255.3.4.5.6.7.8", "1.2.3",
             "4111111111111111", "4111-1111 1111-1111", "4111111111111112", "5", " ", "-", "+1 (705) 555-3818", "+1", "+12345678", "+1 2 3", "++49 30 1234567",
             "é", "\n", "(", ")", ".", "9", "00", "％", "日a@b.c", "٣", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "+1((" * 50_000):
        pii.base_spans(text)  # in no more than linear time


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    sizes, k = np.array([1, 4, 2, 5, 3]), 3
    e, moves = rng.normal(size=(sizes.sum(), k)), rng.normal(size=(k, k))
    got, at = pii.viterbi(e, sizes, moves), 0
    for n in sizes:
        best = max(itertools.product(range(k), repeat=int(n)), key=lambda y: sum(e[at + i, a] for i, a in enumerate(y))
                   + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(got[at:at + n]) == best
        at += n


def test_field_on_unseen_lines():
    model = pii.default_model()
    rows = pii.training_table(seed=77, rounds=3)
    s = pii.shapes("\n".join(" ".join(w for w, _ in r) for r in rows).encode())
    truth = np.array([pii.LABELS.index(k) for r in rows for _, k in r])
    found = pii.viterbi(pii.scores(s, model), np.array([len(r) for r in rows]), model.moves)
    assert (found == truth).mean() > 0.995
    assert not (pii.hopeless(s, model).all())


def test_skipped_lines_are_plain():
    """Lines passed over without decoding decode to no label."""
    model, rng = pii.default_model(), random.Random(8)
    words = ["the", "(a)", "x.", "12", "4.0.", "token", "=", "1999", "A1", "É", '"q"', "a-b", "9" * 15, "@", "+", "ab12cd"]
    rows = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(800)]
    s = pii.shapes("\n".join(" ".join(r) for r in rows).encode())
    sizes = np.array([len(r) for r in rows])
    labels, hopeless = pii.viterbi(pii.scores(s, model), sizes, model.moves), pii.hopeless(s, model)
    first = np.cumsum(sizes) - sizes
    assert not labels[np.repeat(np.logical_and.reduceat(hopeless, first), sizes)].any()


def test_find_and_redact(spark):
    card, secret = "4111111111111111", "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [None, "", "plain words only", f"é mail a.b@c.de or {card} at 10.0.0.1", f'é token = "{secret}" end', "call (705) 555-3818 now",
             "+1 (705) 555-3818 and a@b.c a@b.c", "日本 " * 30_000 + "x@y.zz", "a " * 100_000]
    rows = [(i, t, "en", len(t or "")) for i, t in enumerate(texts)] + [(None, "a@b.c", "en", 5), (1, "", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_chars bigint")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in base[k])
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [len(base[k]) for k in pii.BASE_KINDS]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert got[2].spans == got[8].spans == "" and got[4].spans == f"secret:11:{11 + len(secret)}" and "phone" in got[5].spans
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[0].text is None and out[2].text == texts[2] and out[3].text == "é mail <email> or <card> at <ip>"
    assert out[4].text == 'é token = "<secret>" end' and out[6].text == "<phone> and <email> <email>"
    assert out[None].text == "<email>" and out[None].n_chars == 7 and pii.redact(df).columns == df.columns
    assert pii.find(df.where("false")).count() == 0 and pii.redact(df.where("false")).count() == 0
