import collections
import math
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import lm_score as L
from tableprep.llm.common import shuffles_removed, table

from .helpers import CLASHES, awkward, documents

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, learns, opt):
    """Per row (n_tokens, n_known, N, base, score) by counting n-grams in dictionaries."""
    texts = [(t or "").translate(LOWER).encode().split() + [None] for _, t in rows]
    counts = [collections.Counter(tuple(t[p:p + k + 1]) for t, x in zip(texts, learns, strict=True) if x for p in range(len(t) - k)) for k in range(opt.order)]
    n, v = sum(counts[0].values()), len(counts[0])
    q = lambda p: float(L.restored(L.quantised(np.array([p]), opt.steps), opt.steps)[0])
    out = []
    for t in texts:
        base = [math.log10((counts[0][w,] + 1) / (n + v + 1)) for w in t]
        score = 0.0
        for i, w in enumerate(t):
            p = (counts[0][w,] + 1) / (n + v + 1)
            for k in range(1, min(i, opt.order - 1) + 1):
                total, mu = counts[k - 1][tuple(t[i - k:i])], opt.mu[k]
                if total:
                    p = q(counts[k][tuple(t[i - k:i + 1])] / (total + mu)) + q(mu / (total + mu)) * p
            score += math.log10(p)
        out.append((len(t), sum((w,) in counts[0] for w in t), n, sum(base), score))
    return out


def learns_of(ids):
    return [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i in ids]


def split():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


@pytest.mark.parametrize("opt", [L.LmOptions(block_tokens=5000, shard_items=5000, split_count=50), L.LmOptions(), L.LmOptions(order=1),
                                 L.LmOptions(order=4, mu=(0.0, 100.0, 10.0, 3.0), block_tokens=9000, split_count=10)])
def test_scores_against_dictionaries(spark, opt):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    learns = learns_of([r[0] for r in rows])
    want = {r[0]: w for r, w in zip(rows, brute(rows, learns, opt), strict=True)}
    got = L.score(docs, split(), opt).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], w[3], rel_tol=1e-9) and math.isclose(r["score"], w[4], rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    if opt.order > 1:
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_awkward_rows(spark):
    rows = awkward(2000)
    df = documents(spark, rows, (*CLASHES, "learn", "block", "answers", "score"))
    got = sorted(L.score(df, split()).collect(), key=str)
    want = brute([r[:2] for r in rows], learns_of([r[0] for r in rows]), L.LmOptions())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in got) == sorted((str(r[0]), w[0], w[1], round(w[4], 6)) for r, w in zip(rows, want, strict=True))
    assert L.score(df.limit(0), split()).count() == 0
    assert {r["score"] for r in L.score(df, F.lit(False)).collect()} == {0.0}


def test_elias_fano_and_a_mapped_level():
    rng = np.random.default_rng(5)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 1 << 40, 3000)), np.sort(rng.integers(0, 50, 3000)), [1 << 63, (1 << 64) - 1]):
        e = L.EliasFano.of(np.array(values, np.uint64))
        assert e.all().tolist() == [int(v) for v in values]
        if len(values):
            at = rng.integers(0, len(values), 40)
            assert e.get(at).tolist() == [int(values[i]) for i in at]
            few = L.EliasFano.of(np.array(values, np.uint64))
            assert few.get(at[:9]).tolist() == [int(values[i]) for i in at[:9]] and few.places is None
            lo = rng.integers(0, len(values), 30)
            hi = np.maximum(lo, rng.integers(0, len(values) + 1, 30))
            want = np.array(values, np.uint64)[rng.integers(0, len(values), 30)]
            assert e.at_least(lo, hi, want).tolist() == [next((i for i in range(a, z) if int(values[i]) >= int(w)), z) for a, z, w in zip(lo, hi, want)]
    pairs = sorted({(int(a) * 3, int(b)) for a, b in rng.integers(0, 60, (700, 2))})
    ctx, word = (np.array(x) for x in zip(*pairs, strict=True))
    level = L.Level.build(ctx, word, rng.integers(1, 9, len(pairs)), {}, 5.0, 255)
    with tempfile.TemporaryFile() as f:
        level.write(f)
        got = L.Level.mapped(f)
        assert isinstance(got.successors.highs, np.memmap)
        ask = [(a, b) for a in range(0, 190, 7) for b in range(0, 62, 5)] + pairs[:50]
        want = [pairs.index(p) if p in pairs else -1 for p in ask]
        assert [got.find(np.array([a]), np.array([b]))[0] for a, b in ask] == want
        assert got.find(*(np.array(x) for x in zip(*ask, strict=True))).tolist() == want


def test_quantised_values_are_close():
    p = 10.0 ** np.linspace(-11, 0, 500)
    assert np.abs(np.log10(L.restored(L.quantised(p, 255), 255) / p)).max() < 0.025


def test_distinct_keys():
    rng = np.random.default_rng(2)
    for keys in (np.empty(0, np.int64), np.zeros(5, np.int64), rng.integers(0, 50, 999), rng.integers(0, 1 << 61, 999)):
        a, b = L._distinct(keys), np.unique(keys, return_inverse=True)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_distinct_pairs():
    rng = np.random.default_rng(3)
    for top in (1, 50, 1 << 20, 1 << 40):
        a, b = rng.integers(0, top, 700), rng.integers(0, top, 700)
        a[300:], b[300:] = a[:400], b[:400]
        x, y, same = L._distinct_pairs(a, b)
        assert list(zip(x.tolist(), y.tolist())) == sorted(set(zip(a.tolist(), b.tolist())))
        assert (x[same] == a).all() and (y[same] == b).all()
    assert [len(x) for x in L._distinct_pairs(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0, 0]


def test_words_of_a_block_from_several_batches(monkeypatch):
    """The same texts in one batch and in batches of one row make the same blocks."""
    import pyarrow as pa

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(L, "TaskContext", Context)
    rows = [r[:2] for r in awkward(300)] + [(i, f"Ünd a b{i % 3} c ") for i in range(40)]
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([True] * len(rows))], names=["id", "text", "learn"])
    words = []
    for batches in ([whole], [whole.slice(i, 1) for i in range(len(rows))]):
        got = [b.to_pylist()[0] for b in L._blocks(batches, 200)]
        words.append([(b["ids"], b["lens"], L._unzip(b["data"], 2)[0][L._unzip(b["data"], 2)[1].astype(int)].tolist()) for b in got])
    assert words[0] == words[1] and len(words[0]) > 2


def test_setting_of_shuffle_files_is_restored(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for value in (None, "false"):
        if value:
            spark.conf.set(key, value)
        with shuffles_removed(spark):
            assert spark.conf.get(key) == "true"
        assert spark.conf.get(key, None) == value
    spark.conf.unset(key)
