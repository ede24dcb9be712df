import hashlib
import random

import numpy as np
import pytest

from tableprep.llm import suffix_dedup as S

from .helpers import CLASHES, awkward, documents, prose


def brute(rows, length):
    raws = [(r[1] or "").encode() for r in rows]
    seen: dict = {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p:p + length]] = seen.get(raw[p:p + length], 0) + 1
    out = []
    for r, raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        n = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length):
    got = S.without_repeats(documents(spark, rows, (*CLASHES, "i2", "k2", "first", "spans")), length).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(rows, length)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeüé ") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(90) for _ in range(4)]
    rows = []
    for i in range(25):
        parts = [text(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            parts += [s[a:a + rng.randrange(380, 480)], text(rng.randrange(1, 30))]
        rows.append((i, "".join(parts)))
    check(spark, rows, 400)


def test_lengths_around_the_limit_and_within_one_text(spark):
    a, b = prose(40)[:399], prose(70, 5, 2)[:400]
    rows = [(1, a), (2, a), (3, b), (4, f"x{b}y"), (5, "z" * 900), (6, "ab" * 500), (7, prose(60, 9) + "|" + prose(60, 9) + "|"), (8, "q" * 400)]
    check(spark, rows, 400)


def test_awkward_rows(spark):
    check(spark, [r for r in awkward(3000)], 400)
    assert S.without_repeats(documents(spark, []), 400).count() == 0


def test_windows_cross_the_parts_of_a_long_text(spark, monkeypatch):
    raw = np.frombuffer(prose(4000, 3).encode(), np.uint8)
    monkeypatch.setattr(S, "PART", 1000)
    got = [(a + f, a + z) for a, part in S._parts(raw, 400) for f, z in zip(*S.runs(S.Names(), part, 400)[:2], strict=True)]
    assert [p for f, z in got for p in range(f, z + 1)] == list(range(len(raw) - 399))


def test_planted_passages_of_over_fifty_words_show_in_n_removed(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n, size: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n))
    rows, planted = [], {}
    for size in [9] * 12 + [4] * 12:        # 51 to 60 words: 509 bytes and more, or 299 at most
        passage = text(rng.randrange(51, 61), size)
        for _ in range(2):
            planted[len(rows)] = len(passage)
            rows.append((len(rows), f"{text(30, 6)} {passage} {text(30, 6)}"))
    rows += [(len(rows) + i, text(rng.randrange(20, 150), 6)) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in S.op8_prefix_doubling(spark, str(tmp_path)).collect())
    assert got == sorted(brute(rows, 400))
    for doc_id, n_bytes, n_removed, _, _ in got:
        assert n_bytes == len(rows[doc_id][1])      # the input's size, whatever goes
        assert n_removed >= planted[doc_id] if planted.get(doc_id, 0) >= 400 else n_removed == 0
