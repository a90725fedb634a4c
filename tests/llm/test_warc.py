"""WARC round trip against a plain reading of the definition, and damaged archives."""

import hashlib
import io

import pytest

from textgauge.llm import warc


def test_round_trip(spark):
    big, small = "<p>é</p>" * 50, "tiny"
    rows = [(1, "http://a/b c\r\nX: y", big, "z"), (2, None, small, "z"), (3, "u", small, "z"), (4, "u", big, None),
            (5, "u", None, "z"), (6, "u", "", "z"), (None, "u", big, "z"), (9, "u", "q" * 99, "z"), (10, "u", "q" * 99, "z"),
            (11, "u", "q" * 100, "z"), (12, "u", "q" * 100, "z"), (1, "u", big, "z"), (20, "u", "WARC/1.1\r\n\r\n" * 300_000, "z")]
    rows += [(100 + i, "u", big, "z") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, archive string")
    want = []
    for p, _, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        refers = min(same) if len(data) >= 100 and p is not None and p != min(same) else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers))
    got = warc.round_trip(df).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert "http://a/b%20c%0D%0AX:%20y" in {r.target for r in got}
    assert warc.round_trip(df.where("false")).count() == 0


def test_reader_frames_and_checks():
    payloads = [b"", b"x" * 5000, b"WARC/1.1\r\n\r\n" * 9]
    data = b"".join(warc.encode_record(i, "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))
    for size in (1, 7, 1 << 20):
        assert [warc.payload_of(r) for r in warc.read_records(io.BytesIO(data), size)] == payloads
    wrong = warc.encode_record(1, "u", b"abc", "0" * 64, None)
    for bad in (data[:-3], data[:40], wrong):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(bad), 64))
