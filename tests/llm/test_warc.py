import base64
import hashlib
import uuid

import pytest

from tableprep.llm import warc as W
from tableprep.session import ensure_checkpoint_dir

PAGE = "page_id long, url string, html string"
BREAK = W.SEPARATOR
ROWS = [(3, "http://a", "<p>x</p>"), (1, "http://b\r\nX: y", "<p>x</p>"), (2, None, "ü" * 5000), (4, "u", None), (5, "u", ""), (6, "u", BREAK * 3),
        (7, "u", f"a{BREAK}b{BREAK[:7]}{BREAK}c"), (8, "u", "\r\n" * 999), (9, "u", "\r\n\r\n\r\n"), (10, "u", "ü" * 5000), (10, "u", "ü" * 5000),
        (1, "again", "<p>x</p>"), (None, "u", "only null"), (None, "u", "<p>x</p>"), (11, "WARC/1.1", f"{W.VERSION}\r\nContent-Length: 3\r\n\r\nabc")]


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(ids) if ids and len(raw) >= least else None
        other = first is not None and page != first
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, chunk", [(0, 1 << 20), (0, 7), (100, 64), (0, 1000)])
def test_round_trip(spark, least, chunk):
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    df = spark.createDataFrame(ROWS, PAGE).selectExpr("*", "1 AS sha1", "2 AS first", "3 AS payload", "4 AS bytes")
    W.write_archives(W.record_chunks(df, least, chunk), path)
    got = W.read_records(spark, path).collect()
    assert all(r["intact"] for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(ROWS, least)
    assert max(len(r["block"]) for r in W.read_segments(spark, path).collect()) <= chunk + len(BREAK)
    if chunk == 7:
        assert max(r["n_segments"] for r in got) > 1000


def test_empty_table(spark):
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archives(W.record_chunks(spark.createDataFrame([], PAGE)), path)
    assert W.read_records(spark, path).count() == 0


def test_payloads_over_a_default_chunk(spark):
    """Three whole chunks and a rest, the separator across a border of chunks, and a copy of it."""
    big = "x" * (W.CHUNK_BYTES - 5) + BREAK + "ü" * (W.CHUNK_BYTES + 77)
    rows = [(1, "u", big), (2, "u", big), (3, "u", big + "."), (4, "u", "small")]
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archives(W.record_chunks(spark.createDataFrame(rows, PAGE)), path)
    got = {r["page_id"]: r for r in W.read_records(spark, path).collect()}
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.values()), key=str) == expected(rows)
    assert all(r["intact"] for r in got.values()) and got[1]["n_segments"] == 4 and got[2]["n_segments"] == 1
