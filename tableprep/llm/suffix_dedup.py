"""Operator 8 - exact substring dedup by distributed prefix doubling over content-chosen positions.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too (any document, the same included).

Prefix doubling over every byte position would sort some twenty bytes of state for each byte of text in every round. Here
the positions that enter it are chosen by content: of the ``length - SEED + 1`` places where a seed string of ``SEED`` bytes
lies within a window of ``length`` bytes, the one with the smallest hash, the leftmost of equals. Equal windows choose
the same place, so each window belongs to one position, and the windows of a position are one run of starts. Then ranks
are refined at growing lengths, as in prefix doubling, and what is unique leaves:

1. under a seed (SEED bytes), by the whole run (``length`` bytes and more): equal runs have only repeated windows, and
   a run whose seed is unique has none;
2. runs that differ under one seed, in blocks of BLOCK starts: under the bytes that all windows of a block share, by the
   block's whole bytes; again equal blocks are repeated and blocks whose shared bytes are unique are not;
3. blocks that differ under the same shared bytes, by each window.

Ranks are 64-bit names of the strings (sums of random byte values times powers of an odd number), so each round is
one Spark aggregation with partial sums: a passage in a third of all documents is one row a task. Rows are about 40
bytes for each 150 bytes of text; texts are shuffled compressed, by document.

Defined results: null text is empty; texts under ``length`` bytes keep all; repeated rows are documents of their own,
so each repeats the other; null ids stay; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

SEED = 100
ODD = 0x9E3779B97F4A7C15 | 5
BLOCK = 8
PART = 4 << 20      # bytes of a text that are hashed at once


class Names:
    """64-bit names of substrings of a text of up to PART + some bytes."""

    def __init__(self):
        rng = np.random.default_rng(400)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.size = 0

    def _powers(self, n: int):
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            one = np.full(self.size, ODD, np.uint64)
            one[0] = 1
            self.up = np.multiply.accumulate(one)
            one[1:] = pow(ODD, -1, 1 << 64)
            self.down = np.multiply.accumulate(one)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self._powers(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[:len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        """Names of [start, end), arrays of positions."""
        h = (sums[end] - sums[start]) * self.down[start]
        return _mixed(h + (np.asarray(end) - start).astype(np.uint64))

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Names of every substring of that length, by start."""
        n = len(sums) - length
        h = (sums[length:] - sums[:n]) * self.down[:n]
        return _mixed(h + np.uint64(length))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (w - size)], v[w - size:]) if size < w else v


def runs(names: Names, raw: np.ndarray, length: int):
    """(first, last, place, seed name, run name) of every run of window starts that belong to one position."""
    n = len(raw) - length + 1
    sums = names.sums(raw)
    seeds = names.all(sums, SEED)
    low = np.uint64((1 << 24) - 1)
    chosen = _sliding_min((seeds & ~low) | np.arange(len(seeds), dtype=np.uint64), length - SEED + 1) & low
    first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    place = chosen[first].astype(np.int64)
    return first, last, place, seeds[place], names.of(sums, first, last + length)


def blocks(names: Names, own: np.ndarray, place: int, length: int):
    """(first, last, core name, block name) of a run's blocks; ``own`` are the run's bytes, ``place`` the chosen position
    in them. Borders are counted from the chosen position, so equal content is cut alike."""
    n = len(own) - length + 1
    sums = names.sums(own)
    number = (place - np.arange(n)) // BLOCK
    first = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    core = place - BLOCK * number[first]    # the last start a full block can have; the core lies in each of its windows
    return first, last, names.of(sums, core, core - BLOCK + 1 + length), names.of(sums, first, last + length)


def _parts(raw: np.ndarray, length: int):
    """(offset, bytes) parts that hold every window once."""
    for a in range(0, max(1, len(raw) - length + 1), PART):
        yield a, raw[a:a + PART + length - 1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _packed(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        z = [press.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["id", "k", "z"])


ITEM = "first long, last long, place long, key long, name long, own boolean"


def _batch(ids, cols: list, own) -> pa.RecordBatch:
    cat = [np.concatenate([np.empty(0, np.int64), *(np.asarray(x).view(np.int64) for x in c)]) for c in cols]
    take = pa.array(np.concatenate([np.empty(0, np.int64), *own[0]]).astype(np.int64))
    mine = np.concatenate([np.empty(0, bool), *own[1]])
    return pa.RecordBatch.from_arrays([ids[0].take(take), ids[1].take(take), *(pa.array(c, pa.int64()) for c in cat), pa.array(mine, pa.bool_())],
                                      names=["id", "k", "first", "last", "place", "key", "name", "own"])


def _runs(batches, length: int):
    names = Names()
    for b in batches:
        cols, own = [[] for _ in range(5)], ([], [])
        for i, t in enumerate(b.column(2)):
            raw = np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            for at, part in _parts(raw, length) if len(raw) >= length else ():
                first, last, place, seed, run = runs(names, part, length)
                for c, x in zip(cols, (first + at, last + at, place + at, seed, run), strict=True):
                    c.append(x)
                own[0].append(np.full(len(first), i))
                own[1].append(np.ones(len(first), bool))
        yield _batch((b.column(0), b.column(1)), cols, own)


def _finer(batches, length: int, windows: bool):
    """The blocks, or windows, of the items asked for; rows (id, k, z, asked)."""
    import zstandard

    names, unpack = Names(), zstandard.ZstdDecompressor()
    for b in batches:
        cols, own = [[] for _ in range(5)], ([], [])
        for i, (z, asked) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            raw = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
            for r in asked.as_py():
                mine = raw[r["first"]:r["last"] + length]
                if windows:
                    first = last = np.arange(len(mine) - length + 1)
                    name = names.all(names.sums(mine), length)
                    key = name
                else:
                    first, last, key, name = blocks(names, mine, r["place"] - r["first"], length)
                for c, x in zip(cols, (first + r["first"], last + r["first"], np.full(len(first), r["place"]), key, name), strict=True):
                    c.append(x)
                own[0].append(np.full(len(first), i))
                own[1].append(np.full(len(first), r["own"]))
        yield _batch((b.column(0), b.column(1)), cols, own)


def _round(items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of repeated items, the items to be refined grouped by document)."""
    named = written(items.groupBy("key", "name").agg(F.count("*").alias("n"), F.min(F.struct("id", "k", "first", "last", "place")).alias("one"), F.max("own").alias("own")))
    twice = named.where("n > 1 AND own").select("key", "name")
    spans = items.where("own").join(twice, ["key", "name"], "leftsemi").select("id", "k", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    split = named.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("own") & (F.col("n") == 1)).alias("any")).where("c > 1 AND any").select("key")
    ask = named.join(split, "key", "leftsemi").select("one.*", (F.col("own") & (F.col("n") == 1)).alias("own"))
    return spans, ask.groupBy("id", "k").agg(F.collect_list(F.struct("first", "last", "place", "own")).alias("asked"))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Rows (id, k, start, end), in bytes, that together cover what goes from the documents (id, k, text); k is a hash of
    the text, so equal rows are one document here, all of whose strings are repeated."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, k long, {ITEM}"
    packed = docs.mapInArrow(_packed, f"id {kind}, k long, z binary").withColumnsRenamed({"id": "i2", "k": "k2"})
    on = F.col("id").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2"))
    items = written(docs.mapInArrow(lambda b: _runs(b, length), schema))
    whole, ask = _round(items, length)
    texts = written(ask.join(packed, on).select("id", "k", "z", "asked"))
    items = written(texts.mapInArrow(lambda b: _finer(b, length, False), schema))
    some, ask = _round(items, length)
    rest = ask.join(texts.select(F.col("id").alias("i2"), F.col("k").alias("k2"), "z"), on).select("id", "k", "z", "asked")
    win = written(rest.mapInArrow(lambda b: _finer(b, length, True), schema))
    twice = win.groupBy("name").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 AND own").select("name")
    last = win.where("own").join(twice, "name", "leftsemi").select("id", "k", F.col("first").alias("start"), (F.col("first") + length).alias("end"))
    return whole.unionByName(some).unionByName(last)


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches):
    """Rows (id, z, spans) to the counts and the kept bytes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for z, spans in zip(b.column(1), b.column(2), strict=True):
            raw, gone = unpack.decompress(z.as_py()), _merged([(x["start"], x["end"]) for x in spans.as_py() or []])
            at, kept = 0, []
            for a, e in gone:
                kept.append(raw[at:a])
                at = e
            kept = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", *(x.split()[0] for x in CUT.split(", "))])


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the counts, and the bytes that are kept."""
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    spans = repeated_spans(df, length).groupBy("id", "k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "i2", "k": "k2"})
    packed = df.mapInArrow(_packed, f"id {kind}, k long, z binary")
    on = F.col("id").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2"))
    out = packed.join(spans, on, "left").select("id", "z", "spans").mapInArrow(_cut, f"id {kind}, {CUT}")
    return out.withColumnRenamed("id", id_col)


def op8_prefix_doubling(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_prefix_doubling": op8_prefix_doubling}
ORACLE: dict[str, str] = {}
