"""Binary token files against the tokenizers library, document by document."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textgauge.llm import binary, common


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


def cases():
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abc DEé́ßİ Σς1 2\t\n\x0b\x1c  　'sd.,!<|>中\U0001f600") for _ in range(n))
    texts = [None, "", " \n", "<|endoftext|> a<|startoftext|>b", "it's we'll I'D", "é ́e", "x" * 100_000, "ab " * 20_000, "\x00 a\x00b",
             "straße STRASSE", *[say(rng.randrange(1, 200)) for _ in range(150)]]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, "no id"), (None, None), (7, "seven"), (7, "seven"), (7, "other"), (1 << 62, "last")]


@pytest.mark.parametrize("file_bytes,read_rows", [(binary.FILE_BYTES, binary.READ_ROWS), (3_000, 7)])
def test_round_trip(spark, library, file_bytes, read_rows):
    rows = cases()
    schema = "doc_id bigint, text string, hash string, place int, base long"
    df = spark.createDataFrame([(*r, "h", 1, 2) for r in rows], schema).repartition(5)
    got = binary.round_trip(df, file_bytes=file_bytes, read_rows=read_rows).collect()
    want = sorted(((d, np.array(library(t), dtype="<u4").tobytes()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(
        ((d, len(x) // 4, zlib.crc32(x)) for d, x in want), key=str)
    # In order of start the documents follow each other without a gap, by ascending id.
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_files(spark, library):
    """The files are what their names say: flat ids and 64-bit offsets, readable without Spark."""
    rows = [(i, "one two three " * (i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    folder = common.shared_path(spark, "ids")
    manifest = common.written(binary.write_files(df, folder), "manifest")
    files = binary.with_bases(manifest).orderBy("base").collect()
    data = np.concatenate([np.memmap(f.file, binary.IDS, "r") for f in files])
    starts = np.concatenate([np.fromfile(f.offsets, "<u8")[:-1] + np.uint64(f.base) for f in files])
    assert [data[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)] == [library(t) for _, t in rows]


def test_one_id_for_all(spark, library):
    """Rows that share one id are cut into several ranges all the same."""
    rows = [(7, f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    manifest = common.written(binary.write_files(df, common.shared_path(spark, "ids"), file_bytes=500), "manifest")
    assert manifest.count() >= 5 and manifest.agg({"n_rows": "max"}).first()[0] < 200
    got = binary.read_files(binary.with_bases(manifest), common.shared_path(spark, "ids")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library(t)) for _, t in rows)


def test_range_of():
    ids, places = np.array([1, 5, 5, 5, 9, 2]), np.array([3, 0, 4, 9, 1, 8])
    got = binary.range_of(ids, places, np.array([2, 5, 5, 8]), np.array([9, 4, 6, 0]))
    assert got.tolist() == [sum((b, p) <= (i, q) for b, p in [(2, 9), (5, 4), (5, 6), (8, 0)]) for i, q in zip(ids, places, strict=True)]


def test_pieces_against_library():
    """Texts of letters, marks, signs and blanks that a wrong cut would show in."""
    rng = random.Random(1)
    signs = "abzéßÿ÷×ñ AZÉÀ.,!'-s\t\n\x0b\x0c\x1c\x85\xa0\u0323\u0301\u030cJjH\u0331tT\u0308012½²中Σςσ\U0001f600İI\u212a 'st'll\x00<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(20_000)]
    encoder = binary.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    got = encoder.encode([t.encode() for t in texts])
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(g, "<u2").tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_empty(spark):
    assert binary.round_trip(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ids_must_fit():
    with pytest.raises(ValueError):
        binary.Encoder(public_tokenizers.path("word_bpe_49k.json"), "u1")


def test_latin_words_take_the_merges_alone(library):
    """Words with letters beyond ASCII, capitals and a stop go the short way, each distinct piece once."""
    texts = ["Éle vergeß. ÜBER, señor! Große ", "éle señor. Große"] * 50
    encoder = binary.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    pieces, which, edges = binary.pieces_of([t.encode() for t in texts])
    assert len(pieces) == len(set(pieces)) == 9 and [pieces[i] for i in which[edges[1]:edges[2]]] == ["éle".encode(), "señor".encode(), b".", "Große".encode()]

    class Whole:
        """The library's tokenizer, noting what goes to all of its steps."""

        model, seen = encoder.tokenizer.model, []

        def encode_batch_fast(self, some, **how):
            self.seen.extend(some)
            return made.encode_batch_fast(some, **how)

        encode_batch = encode_batch_fast

    made, encoder.tokenizer = encoder.tokenizer, Whole()
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library(t)[:-1] for t in texts]
    assert set(Whole.seen) == {".", ",", "!"} and len(Whole.seen) == 3
