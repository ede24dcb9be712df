import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableprep.llm import importance as I
from tableprep.llm.common import table

from .helpers import CLASHES, awkward, documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """The contract, by n-gram strings; rows as (doc_id, n_features, weight, score, rank)."""
    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[3], r[2], r[1]))
    drawn = Counter()
    ranks = {}
    for k, r in enumerate(order[: 5 * len(order) // 100], 1):
        ranks.setdefault(r, []).append(k)
    out = []
    for r in rows:
        out.append((r[0], r[2], r[3], r[4], ranks[r][drawn[r]] if drawn[r] < len(ranks.get(r, [])) else None))
        drawn[r] += 1
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("texts", [["a b c\nd e", "a b\nc", "A-b_C,d\n\n\ne f g h i\n j"], ["x" * 70 + " y " + "z" * 300 + "\n" + "é" * 40 + " ü"]])
def test_buckets(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    got = {r["bucket"]: r["n"] for r in I.bucket_counts(df).collect()}
    assert got == {b: 3 * n for b, n in Counter(b for t in texts for b in features(t)[1]).items()}


def test_query_against_brute_force(spark):
    got = [tuple(r) for r in I.op13_importance_resampling(spark, SF).collect()]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want = brute(docs, [r["text"] for r in table(spark, SF, "benchmark").collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in got) >= 5


def test_awkward_rows(spark):
    rows = awkward(3000) + [(100 + i, "one two three four five " * 5 + f"w{i % 7}\nnext line {i % 3}\nx") for i in range(200)]
    df = documents(spark, rows, (*CLASHES, "score", "weight", "rank", "t", "times", "open", "range_no"))
    target = spark.createDataFrame([("two three\nfour",), (None,), ("",)], "text string")
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in I.resample(df, target).collect()]
    assert sorted(got, key=key) == sorted(brute([(r[0], r[1]) for r in rows], ["two three\nfour", "", ""]), key=key)


def test_copies_fill_no_range(spark):
    """Many equal rows (one id) tie in everything: each gets a rank of its own."""
    rows = [(7, 30, 87, 5, 900)] * 400 + [(i, 25, 72, 5, i) for i in range(600)] + [(None, 19, 54, 5, 9999)] * 3
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    for percent, ids in ((10, {7}), (50, {7, *range(500, 600)})):
        out = I.drawn(df, I.Resampling(percent=percent))
        got = out.where("rank is not null").orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, 10 * percent + 1)) and {r["doc_id"] for r in got} == ids
        assert out.count() == len(rows)


def test_empty_tables(spark):
    none = documents(spark, [(1, "x")]).limit(0)
    assert I.resample(none, none).count() == 0
    got = I.resample(documents(spark, [(1, "a b")]), none).collect()
    assert len(got) == 1 and got[0]["rank"] is None and got[0]["n_features"] == 3


def test_equal_at_any_partitioning(spark):
    docs, target = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    a = I.resample(docs.repartition(7), target).select(F.sum(F.hash("doc_id", "weight", "score", "rank"))).first()[0]
    assert a == I.resample(docs.coalesce(1), target).select(F.sum(F.hash("doc_id", "weight", "score", "rank"))).first()[0]
