import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import periodic as P
from tableprep.llm.common import table

from .helpers import CLASHES, awkward, documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) of all runs, by every shift; the smallest period of a stretch is looked for afresh."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    a, n, out = np.array([ids[x] for x in w], np.int64), len(w), []
    for q in range(1, n // 3 + 1):
        equal = np.concatenate(([False], a[q:] == a[:-q], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for s, e in zip(edges[::2], edges[1::2]):
            if e + q - s >= max(24, 3 * q) and not any((a[s:e + q - d] == a[s + d:e + q]).all() for d in range(1, q)):
                out.append((int(s), int(e + q - s), q))
    return sorted((s, n, q) for s, n, q in out)


def changed(doc_id, text):
    w = WORD.findall((text or "").encode())
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def brute(doc_id, w):
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    s, n, q = best or (None, None, None)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def by_tiles(w, rule=P.RunRule()):
    """Runs of one text through tiles and fragments, stitched here as Spark does it."""
    ids, found = P._numbered(w), {}
    for p, at, part in P.tiles(ids, rule):
        for q, s, e in P.fragments(part, p, rule, at == 0, at + len(part) == len(ids)):
            found.setdefault(q, []).append((at + s, at + e))
    out = []
    for q, parts in found.items():
        done = []
        for s, e in sorted(parts):
            if done and done[-1][1] - s >= q:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out += [(s, e - s, q) for s, e in done if e - s >= rule.least(q)]
    return sorted(out)


def sequences():
    r = random.Random(5)
    yield "a " * 500
    yield "a b " * 300 + "c"
    yield "a a a a a a a a b " * 40
    yield ("a " * 200 + "b ") * 9 + "a " * 77
    yield " ".join(f"x{i % 97}" for i in range(1000))
    yield ("a " * 60 + "b " + "a " * 31 + "c ") * 5
    for k in range(60):
        letters, n = r.choice([1, 2, 3, 9]), r.randrange(0, 700)
        w = [str(r.randrange(letters)) for _ in range(n)]
        for _ in range(r.randrange(4)):     # runs, some within others
            if n:
                a, p = r.randrange(n), r.randrange(1, 120)
                for i in range(a + p, min(n, a + p * r.randrange(2, 9) + r.randrange(p))):
                    w[i] = w[i - p]
        yield " ".join(w)
    w = ["p", "q"]
    while len(w) < 900:     # a Fibonacci word: as many repetitions as there can be
        w = w + w[: len(w) // 2] if r.random() < 0.3 else w + w[: len(w) * 5 // 8]
    yield " ".join(w)


@pytest.mark.parametrize("tile", [1 << 16, 40])
def test_tiles_against_brute_force(monkeypatch, tile):
    """Small tiles make many pieces of the same run; the result doesn't change."""
    monkeypatch.setattr(P, "TILE", tile)
    P._powers.clear()
    for text in sequences():
        w = text.encode().split()
        assert by_tiles(w) == brute_runs(w), text[:200]


def test_hashes_only_filter(monkeypatch):
    """With a hash that calls all windows equal every run is still found, and no other."""
    monkeypatch.setattr(P, "window_hashes", lambda w, p: np.zeros(len(w) - p + 1, np.uint64))
    for text in list(sequences())[:25]:
        w = text.encode().split()[:300]
        assert by_tiles(w) == brute_runs(w)


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want = [brute(i, changed(i, t)) for i, t in docs]
    assert sorted(rows_of(P.op12_periodic_runs(spark, SF)), key=key) == sorted(want, key=key)
    assert sum(x[1] > 0 for x in want) > 10


@pytest.mark.parametrize("wide, tile", [(4 << 20, 1 << 16), (500, 64)])
def test_awkward_rows(spark, monkeypatch, wide, tile):
    """Also with tiles dealt over tasks, where a run's pieces come from several of them."""
    rows = awkward(2000) + [(8, "x y z " * 100), (8, "x y w " * 100), (8, "x y z " * 100), (None, "k " * 90), (9, "é ü\x1c ö " * 40)]
    rows += [(20 + k, "un deux " * k + " ".join(f"m{i}" for i in range(200)) + " trois quatre cinq" * 30) for k in range(12, 30)]
    df = documents(spark, rows, (*CLASHES, "doc", "period", "octave", "runs", "i", "t", "plain"))
    monkeypatch.setattr(P, "WIDE", wide)
    got = P.periodic_runs(df)
    want = [brute(r[0], WORD.findall((r[1] or "").encode())) for r in rows]
    assert sorted(rows_of(got), key=key) == sorted(want, key=key)
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_texts(spark):
    df = documents(spark, [(1, "start " + "a b c " * 10 + "end"), (2, "no runs here"), (3, None)])
    got = {r["doc_id"]: bytes(r["collapsed"]).decode() for r in P.periodic_runs(df, texts=True).collect()}
    assert got == {1: "start a b c end", 2: "no runs here", 3: ""}


def test_stitching(spark):
    rows = [("d", 4, 0, 40), ("d", 4, 30, 70), ("d", 4, 66, 90), ("d", 4, 87, 130), ("d", 5, 30, 70), ("e", 4, 36, 52), ("d", 4, 0, 40)]
    got = P.stitched(spark.createDataFrame(rows, "doc string, period long, s long, e long"))
    assert {(r["doc"], r["period"], r["start"], r["length"]) for r in got.collect()} == {("d", 4, 0, 90), ("d", 4, 87, 43), ("d", 5, 30, 40)}
    assert got.select(F.count("*")).first()[0] == 3
