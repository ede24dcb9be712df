"""Operator 12 - periodic runs of words, distributed by tiles of one scale each.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least ``max(24, 3 q)`` words long.

**Tiles.** For each octave of periods [P, 2P) a document's words (as numbers) are cut into tiles that overlap by 4P words,
so a tile sees at least four periods beyond its own part and pieces of one run in neighbouring tiles share a period. A tile
row knows nothing of others. The tiles of texts above ``WIDE`` characters are dealt over the cluster, those of the others are
solved where they are cut; the same functions do both.

**Solving.** A stretch of period q in [P, 2P) repeats some block of P words that begins at a multiple of P, q words later.
Window hashes find those places (one comparison of arrays for an octave); at the boundary before such a block, Z-functions of
the words after it and, reversed, before it give for all q at once how far the repetition goes on either side. Hashes are
only a filter: equal windows always have equal hashes, and lengths come from the words. Periods whose block is itself a
repetition belong to a lower octave and are left to it. The periods below ``LOW`` are one octave, compared shift by shift.

**Stitching.** Fragments (document, period, from, to) are shuffled by document and period; those that share a period's
length or more are one run. Only fragments, and the words of documents that have any, leave the tasks.

Defined results: null or empty text has no words and no runs, and the digests of the empty text; documents are told apart by
id and words, so equal rows get equal results, one each, and a clashing id doesn't mix texts; null ids stay; further columns are
ignored; an empty table gives no rows. Ties are broken by smaller start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import table

LOW = 8                 # periods below are one octave
TILE = 1 << 16          # words of a tile's own part, at least
WIDE = 4 << 20          # characters; tiles of longer texts are dealt over the cluster
BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class RunRule:
    min_words: int = 24
    min_periods: int = 3

    def __post_init__(self):
        if not 3 <= self.min_periods <= 5:
            raise ValueError("min_periods is 3 to 5: blocks and boundary windows are laid out for these")

    def least(self, q: int) -> int:
        return max(self.min_words, self.min_periods * q)


# ---------------------------------------------------------------- cutting

def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def octaves(n: int, rule: RunRule) -> list[int]:
    """The lower ends of the octaves in which ``n`` words can have a run."""
    out, p = ([1] if n >= rule.min_words else []), LOW
    while rule.least(p) <= n:
        out.append(p)
        p *= 2
    return out


def tiles(ids: np.ndarray, rule: RunRule):
    """(octave, first word, words) of every tile."""
    n = len(ids)
    for p in octaves(n, rule):
        over = max(4 * p, 4 * LOW, rule.min_words)
        step = max(TILE, 2 * over)
        at = 0
        while True:
            yield p, at, ids[at:at + step + over]
            if at + step + over >= n:
                break
            at += step


TILE_ROW = "doc string, octave int, at long, n_words long, ids binary, doc_id long, text binary"
TILE_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
TILE_NAMES = [x.split()[0] for x in TILE_ROW.split(", ")]


def _batch(rows, names, types):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's change: in a tenth of the documents the words from some place on repeat with some period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def _cut(rule: RunRule, change):
    """Document rows (id, text bytes) to tile rows; after its tiles a document's own row, without an octave."""
    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                doc_id, words = i.as_py(), (t.as_py() or b"").split()
                if change is not None:
                    words = change(words, doc_id)
                text = b" ".join(words)
                doc = f"{doc_id}:{hashlib.md5(text).hexdigest()}"
                for p, at, part in tiles(_numbered(words), rule):
                    rows.append((doc, p, at, len(words), part.tobytes(), None, None))
                    size += 4 * len(part)
                    if size > 4 << 20:
                        yield _batch(rows, TILE_NAMES, TILE_TYPES)
                        rows, size = [], 0
                rows.append((doc, None, None, len(words), None, doc_id, text))
                size += len(text)
                if size > 4 << 20:
                    yield _batch(rows, TILE_NAMES, TILE_TYPES)
                    rows, size = [], 0
        yield _batch(rows, TILE_NAMES, TILE_TYPES)
    return run


# ---------------------------------------------------------------- solving one tile

def z_function(s: list[int]) -> np.ndarray:
    """z[i]: how many words from i on equal the first ones."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:      # else it is known to end before
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z, np.int64)


def _reach(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i and j on are equal (i < j), looked at in growing pieces."""
    n, k, step = len(w), 0, 64
    while j + k < n:
        m = min(step, n - j - k)
        differ = np.flatnonzero(w[i + k:i + k + m] != w[j + k:j + k + m])
        if len(differ):
            return k + int(differ[0])
        k, step = k + m, step * 2
    return k


def _stretch(w: np.ndarray, back: np.ndarray, m: int, q: int) -> tuple[int, int]:
    """The longest stretch of period ``q`` around the words m and m + q."""
    n = len(w)
    after = _reach(w, m, m + q)
    before = _reach(back, n - m - q, n - m) if m else 0
    return m - before, m + q + after


def _low_fragments(w: np.ndarray, rule: RunRule, first: bool, last: bool):
    n = len(w)
    for q in range(1, min(LOW, n)):
        equal = w[q:] == w[:-q]
        least = rule.least(q) - q
        # a piece at an open edge may be short: the rest of it is in the next tile
        open_left, open_right = not first and equal[0], not last and equal[-1]
        if not open_left and not open_right and np.count_nonzero(equal) < least:
            continue
        ends = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
        for s, e in zip(ends[::2].tolist(), ends[1::2].tolist()):
            at_edge = (open_left and s == 0) or (open_right and e == n - q)
            if e - s >= (q if at_edge else least) and not any(q % d == 0 and (w[s:s + q - d] == w[s + d:s + q]).all() for d in range(1, q)):
                yield q, s, e + q


_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the longest tile of the task."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.full(max(n, TILE), b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def window_hashes(w: np.ndarray, p: int) -> np.ndarray:
    """A number for each window of ``p`` words; equal windows have equal numbers."""
    power, inverse = _powers_of(len(w))
    x = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power)))
    return (total[p:] - total[:-p]) * inverse[: len(w) - p + 1]


def _candidates(w: np.ndarray, p: int):
    """Anchors (multiples of ``p``) and, for each, the periods in [p, 2p) at which their block of ``p`` words may come again."""
    h = window_hashes(w, p)
    later = h[p:]
    rows = -(-len(later) // p)
    grid = np.zeros(rows * p, np.uint64)
    grid[: len(later)] = later
    anchors = h[: rows * p: p]
    found = grid.reshape(rows, p)[: len(anchors)] == anchors[:, None]
    found.reshape(-1)[len(later):] = False
    a, d = np.nonzero(found)
    return a * p, d + p


def _high_fragments(w: np.ndarray, p: int, rule: RunRule, first: bool, last: bool):
    n = len(w)
    if n < 2 * p:
        return
    at, period = _candidates(w, p)
    if not len(at):
        return
    back = w[::-1]
    known: list[tuple[int, int, int]] = []      # stretches (from, to, smallest period) found so far

    def uncovered(m, q):
        for s, e, d in known:
            if s <= m:
                q = q[(m + q > e) | (q % d != 0)]
        return q

    cuts = np.flatnonzero(np.diff(at)) + 1
    for m, q in zip(at[np.concatenate(([0], cuts))].tolist(), np.split(period, cuts)):
        known = [x for x in known if x[1] > m]
        q = uncovered(m, q)
        if not len(q):
            continue
        ahead = z_function(w[m:m + 6 * p].tolist())
        lo, hi = max(0, m - 4 * p), min(n, m + 2 * p)
        # the words before the boundary, backwards, then those around it: how far the words before m and m + q agree
        behind = z_function(back[n - m:n - lo].tolist() + [-1] + back[n - hi:n - lo].tolist())
        q = q[m + q < n]
        after = ahead[q]
        before = behind[(m - lo) + 1 + (hi - m - q)] if m > lo else np.zeros(len(q), np.int64)
        before = np.minimum(before, m - lo)
        # a stretch long enough, or one that reaches an open edge of the tile
        whole = after + before >= (rule.min_periods - 1) * q
        edge = ((not last) & (m + q + after >= n)) | ((not first) & (before >= m))
        q = q[whole | (edge & (after + before >= q))]
        # the block's smallest period; a q that is a multiple of a smaller period belongs to a lower octave
        low = np.flatnonzero(ahead[1:p] >= p - np.arange(1, min(p, len(ahead))))
        root = int(low[0]) + 1 if len(low) else 0
        while len(q):
            x = int(q[0])
            d = next((d for d in (x // 2 if x % 2 == 0 else 0, x // 3 if x % 3 == 0 else 0, root if root and x % root == 0 else 0)
                      if 0 < d < x and ahead[d] >= x - d), x)
            if d < x and root and d % root == 0 and ahead[root] >= x - root:
                d = root
            s, e = _stretch(w, back, m, d)
            known.append((s, e, d))
            open_end = (s == 0 and not first) or (e == n and not last)
            if d == x and e - s >= (2 * x if open_end else rule.least(x)):
                yield x, s, e
            q = uncovered(m, q[1:])


def fragments(w: np.ndarray, p: int, rule: RunRule, first: bool, last: bool):
    """(period, from, to) of the stretches in a tile; ``first`` and ``last``: nothing of the document is before, after it."""
    return _low_fragments(w, rule, first, last) if p < LOW else _high_fragments(w, p, rule, first, last)


FRAGMENT_ROW = "doc string, period long, s long, e long, doc_id long, n_words long, text binary, plain string"
FRAGMENT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
FRAGMENT_NAMES = [x.split()[0] for x in FRAGMENT_ROW.split(", ")]


def _solve(rule: RunRule, told: bool):
    """Tile rows to fragment rows, and document rows. With ``told`` a document's tiles all come before its own row, and
    one without fragments keeps its digest only."""
    def run(batches):
        some = False
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["octave"] is None:
                    keep = some or not told
                    plain = None if keep else hashlib.sha256(r["text"]).hexdigest()
                    rows.append((r["doc"], None, None, None, r["doc_id"], r["n_words"], r["text"] if keep else None, plain))
                    some = False
                    continue
                w = np.frombuffer(r["ids"], np.int32)
                at, n = r["at"], r["n_words"]
                for q, s, e in fragments(w, r["octave"], rule, at == 0, at + len(w) == n):
                    rows.append((r["doc"], q, at + s, at + e, None, None, None, None))
                    some = True
            yield _batch(rows, FRAGMENT_NAMES, FRAGMENT_TYPES)
    return run


# ---------------------------------------------------------------- stitching

def stitched(found: DataFrame, rule: RunRule = RunRule()) -> DataFrame:
    """Rows (doc, period, start, length): fragments of one document and period that share a period's length are one run."""
    by = Window.partitionBy("doc", "period").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.distinct().withColumn("new", F.when(reach - F.col("s") >= F.col("period"), 0).otherwise(1))
    parts = parts.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("doc", "period", "run").agg(F.min("s").alias("start"), (F.max("e") - F.min("s")).alias("length"))
    return runs.where(F.col("length") >= F.greatest(F.lit(rule.min_words), rule.min_periods * F.col("period"))).drop("run")


OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed binary"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]
OUT_TYPES = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.binary()]
NO_RUNS = hashlib.sha256(b"").hexdigest()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of all runs (start, length, period) and those of a run's first period that no other run drops."""
    drop = np.zeros(len(words) + 1, np.int32)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _finished(texts: bool):
    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                runs = sorted((x["start"], x["length"], x["period"]) for x in r["runs"] or ())
                left = b" ".join(collapse(r["text"].split(), runs)) if runs else r["text"]
                best = None
                for x in runs:      # greatest length / period, compared exactly
                    if best is None or x[1] * best[2] > best[1] * x[2] or (x[1] * best[2] == best[1] * x[2] and (x[0], x[2]) < (best[0], best[2])):
                        best = x
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                s, n, q = best or (None, None, None)
                rows.append((r["doc_id"], r["n_words"], len(runs), s, n, q, 1000 * n // q if best else None, hashlib.sha256(lines).hexdigest(),
                             hashlib.sha256(left).hexdigest(), left if texts else None))
            yield _batch(rows, OUT_NAMES, OUT_TYPES)
    return run


def periodic_runs(docs: DataFrame, rule: RunRule = RunRule(), id_col: str = "doc_id", text: str = "text", change=None,
                  texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: n_runs, the best run, digests of all runs and of the collapsed text (with ``texts``, that
    text as well). ``change`` is a function (words, id) -> words applied before the search."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    narrow = F.coalesce(F.length("t"), F.lit(0)) <= WIDE
    raw = lambda x: x.select("i", F.col("t").cast("binary").alias("t")).mapInArrow(_cut(rule, change), TILE_ROW)
    here = raw(rows.where(narrow)).mapInArrow(_solve(rule, not texts), FRAGMENT_ROW)
    away = raw(rows.where(~narrow)).repartition("doc", "octave", "at").mapInArrow(_solve(rule, False), FRAGMENT_ROW)
    mixed, _ = write_and_read(here.unionByName(away))
    plain = mixed.where(F.col("plain").isNotNull())
    done = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"),
                        *(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")),
                        F.lit(NO_RUNS).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"), F.lit(None).cast("binary").alias("collapsed"))
    found = mixed.where(F.col("period").isNotNull()).select("doc", "period", "s", "e")
    runs = stitched(found, rule).groupBy("doc").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    rest = mixed.where(F.col("text").isNotNull()).select("doc", "doc_id", "n_words", "text").join(runs, "doc", "left")
    rest = rest.select("doc_id", "n_words", "text", "runs").mapInArrow(_finished(texts), OUT)
    return done.unionByName(rest)


def op12_periodic_runs(spark, sf_dir):
    out = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=planted)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE: dict[str, str] = {}
