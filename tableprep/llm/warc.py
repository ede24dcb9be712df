"""Operator 2 - WARC archives over a chunked record table.

Writing: every page becomes a record; of records with equal payloads the one with the smallest id is the ``response``,
the others are ``revisit`` records without payload. A payload is cut, inside Spark, into rows (record, chunk number,
chunk) of at most ``chunk_bytes``, and each row is written as one WARC segment (``WARC-Segment-Number``; the further
segments are ``continuation`` records), so no task builds a whole record. Spark's text writer makes the archives, on
whatever store the cluster uses.

Reading: Spark's text reader splits the archives at the record separator (chunks are cut so that none holds it), the
segments of a record are sorted together by number, and a running SHA-1 is carried over them, row by row.

Defined results: null or empty html is an empty payload; a null page id takes no part in choosing the smallest id - if all
ids of equal payloads are null, all are responses; equal rows with the smallest id are all responses; other repeated
rows are a record each; further columns are ignored; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import table

VERSION = "WARC/1.1"
SEPARATOR = f"\r\n\r\n{VERSION}\r\n"
CHUNK_BYTES = 1 << 20


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_chunks(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id",
                  url: str = "url", payload: str = "html") -> DataFrame:
    """Rows (record, page_id, url, refers_to, sha1, bytes, chunk_no, n_chunks, chunk); revisits have one empty chunk."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                     F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    # min_by keeps one row a digest and task before the shuffle, so a digest with a third of all rows is cheap
    first = p.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"))
    p = p.withColumn("sha1", F.col("sha1")).join(first, ["sha1", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn("record", F.monotonically_increasing_id())
    p = p.withColumn("payload", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk_bytes)).cast("int")
    p = p.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(1), n)))
    chunk = F.substring(F.col("payload"), (F.col("chunk_no") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    return p.select("record", "page_id", "url", "refers_to", "sha1", "bytes", "chunk_no", "n_chunks", chunk.alias("chunk"))


def _safe_parts(chunk: bytes) -> list[bytes]:
    """The chunk in pieces that don't make the separator, neither alone nor with the line ends before and after a block."""
    mark, framed = SEPARATOR.encode(), b"\r\n\r\n" + chunk + b"\r\n\r\n"
    parts, at, x = [], 0, framed.find(mark)
    while x >= 0:
        parts.append(chunk[at:x + 1])       # up to the W of the version line
        at = x + 1
        x = framed.find(mark, x + 1)
    return [*parts, chunk[at:]]


def _segments(batches):
    """Chunk rows to WARC segments, one row of bytes each. A record's chunks come one after another."""
    number, current = 0, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["record"] != current:
                current, number = r["record"], 0
            last = r["chunk_no"] == r["n_chunks"]
            parts = _safe_parts(r["chunk"])
            for i, part in enumerate(parts):
                number += 1
                end = last and i == len(parts) - 1
                kind = "continuation" if number > 1 else "revisit" if r["refers_to"] is not None else "response"
                head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-record:{r['record']}:{number}>",
                        f"WARC-Segment-Origin-ID: <urn:x-record:{r['record']}>", f"WARC-Segment-Number: {number}",
                        "Content-Type: text/html; charset=utf-8"]
                if number == 1:
                    head += [f"WARC-Target-URI: {''.join(' ' if c < ' ' else c for c in r['url'] or '')}", f"WARC-Payload-Digest: sha1:{_base32(r['sha1'])}",
                             f"X-Payload-Length: {r['bytes']}"]
                    head += [f"X-Page-ID: {r['page_id']}"] * (r["page_id"] is not None)
                    head += [f"WARC-Refers-To: <urn:x-page:{r['refers_to']}>"] * (kind == "revisit")
                if end:
                    head.append(f"X-Segments: {number}")
                lines = "".join(f"{x}\r\n" for x in [VERSION, *head, f"Content-Length: {len(part)}"])
                # the writer ends each row with \r\n\r\n
                out.append(lines.encode("utf-8", "replace") + b"\r\n" + part)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(chunks: DataFrame, path: str) -> None:
    """Writes gzip-compressed archives, one for each task, below ``path`` with Spark's text writer."""
    rows = chunks.select("record", "page_id", "url", "refers_to", "sha1", "bytes", "chunk_no", "n_chunks", "chunk").mapInArrow(_segments, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


HEAD = "record long, number int, segments int, kind string, page_id long, refers_to long, url string, bytes long, digest string, block binary"


def _parsed(batches):
    names = [x.split()[0] for x in HEAD.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for b in batches:
        rows = []
        for raw in b.column(0):
            raw = raw.as_py().removeprefix(f"{VERSION}\r\n".encode())
            head, _, block = raw.partition(b"\r\n\r\n")
            h = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
            block = block[: int(h["Content-Length"])]
            page, refers = h.get("X-Page-ID"), h.get("WARC-Refers-To")
            rows.append((int(h["WARC-Segment-Origin-ID"].split(":")[2][:-1]), int(h["WARC-Segment-Number"]),
                         int(h["X-Segments"]) if "X-Segments" in h else None, h["WARC-Type"], int(page) if page else None,
                         int(refers.split(":")[2][:-1]) if refers else None, h.get("WARC-Target-URI"),
                         int(h["X-Payload-Length"]) if "X-Payload-Length" in h else None,
                         h["WARC-Payload-Digest"].removeprefix("sha1:") if "WARC-Payload-Digest" in h else None, block))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int, intact boolean"


def _folded(batches):
    """Segments, sorted by record and number, to one row a record; the digest is carried over the segments."""
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
    head, sha, size, n = None, None, 0, 0

    def done():
        digest = base64.b32encode(sha.digest()).decode()
        if head["kind"] == "revisit":
            return head["page_id"], head["url"], head["bytes"], head["digest"], "revisit", head["refers_to"], n, True
        return head["page_id"], head["url"], size, digest, "response", None, n, digest == head["digest"] and size == head["bytes"]

    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["number"] == 1:
                if head is not None:
                    out.append(done())
                head, sha, size, n = r, hashlib.sha1(), 0, 0
            sha.update(r["block"])
            size += len(r["block"])
            n += 1
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(), kinds, strict=True)], names=names)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below ``path``: a row for each segment."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.where(F.length("value") > 4).mapInArrow(_parsed, HEAD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: ids, the payload's length and digest as read, whether both agree with the header (``intact``).

    Records of one segment are folded where they are read; only the segments of longer ones are shuffled, by record."""
    seg = read_segments(spark, path)
    single = (F.col("number") == 1) & (F.coalesce("segments", F.lit(0)) == 1)
    ones = seg.where(single).mapInArrow(_folded, OUT)
    more = seg.where(~single).repartition("record").sortWithinPartitions("record", "number").mapInArrow(_folded, OUT)
    return ones.unionByName(more)


def op2_chunked_records(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(record_chunks(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "intact")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
b AS (SELECT page_id, t, n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p),
v AS (SELECT page_id, n, h, first, list_transform(range(0, 32), lambda i:
        list_sum(list_transform(range(0, 5), lambda k: CASE WHEN (strpos('0123456789abcdef', h[(5 * i + k) // 4 + 1]) - 1)
          & (1 << (3 - (5 * i + k) % 4)) <> 0 THEN 1 << (4 - k) ELSE 0 END))) AS q FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(q, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x::BIGINT + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  1 AS n_segments, true AS intact FROM v"""

QUERIES = {"op2_chunked_records": op2_chunked_records}
ORACLE = {"op2_chunked_records": OP2_SQL}
