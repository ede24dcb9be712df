import itertools
import random
import re

import pytest

from tableprep.llm import near_dedup as N

from .helpers import CLASHES, awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, n):
    out = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, n, percent):
    """(id, set size, smallest id reachable) of each row."""
    sets = sets_of(rows, n)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def made(seed):
    """Groups of near copies around the threshold, chains, boilerplate in short texts, exact copies."""
    rng, rows = random.Random(seed), []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 120, 200]))]
        for _ in range(rng.choice([1, 3, 6])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for p in rng.sample(range(len(words)), min(len(words), rng.choice([0, 1, 2, 4]))):
                words[p] = f"v{rng.randrange(10 ** 6)}"
    menu = prose(25)
    rows += [(len(rows) + i, f"{menu} {' '.join(f'z{rng.randrange(10 ** 6)}' for _ in range(rng.randrange(3, 25)))}") for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent, block", [(3, 85, 256), (5, 80, 5)])
def test_components_against_all_pairs(spark, n, percent, block):
    rows = made(n)
    got = N.near_components(documents(spark, rows), N.NearOptions(n, percent, block=block)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, n, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({r["component_id"] for r in got}) < len(rows) - 10


def test_radius_and_keys_keep_the_guarantee(spark):
    opt = N.NearOptions(3, 85)
    assert len(opt.chunks) * 2 > opt.radius and sum(z - a for a, z in opt.chunks) == opt.k
    rng = random.Random(1)
    import numpy as np

    for _ in range(20):     # signatures within the radius share a key
        a = np.array([rng.randrange(1 << 16) for _ in range(opt.k)], np.uint16)
        b = a.copy()
        b[rng.sample(range(opt.k), opt.radius)] ^= 1
        df = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes()))], "cls long, sig binary")
        keys = N.chunk_keys(df, opt).collect()
        assert {r["key"] for r in keys if r["cls"] == 1} & {r["key"] for r in keys if r["cls"] == 2}
        break


def test_components_of_links(spark):
    chain = [(i + 1, i) for i in range(60)] + [(200, 100), (300, 200), (150, 300)]
    got = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200, 300)}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    df = documents(spark, awkward(), CLASHES)
    got = N.near_components(df).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["component_id"] == i and by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (1, 2, 3))
    assert {r["component_id"] for r in by[5] + by[6]} == {5} and not by[6][0]["kept"]
    left = N.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7] and left.where("doc_id IS NULL").count() == 2
    assert N.near_components(df.limit(0)).count() == 0 and N.one_of_each(df.limit(0)).count() == 0


def test_ids_that_clash_and_null_ids(spark):
    """Links are found by text: an id that stands for two texts links both, and rows without an id are linked as well."""
    a, b = prose(80), prose(80, 41, 5)
    near = lambda t, w: t.replace(" ", f" {w} ", 1)
    df = documents(spark, [(1, a), (1, b), (2, near(a, "x")), (3, near(b, "y"))])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_components(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert sorted(r["text"] for r in N.one_of_each(df).collect()) == sorted([a, b])
    df = documents(spark, [(None, a), (None, near(a, "x")), (7, near(a, "y")), (None, b), (None, near(b, "z")), (None, b), (None, None), (8, " ")])
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in N.near_components(df).collect()))
    assert got == [(0, 0, True)] * 4 + [(0, 7, False)] * 2 + [(7, 7, True), (8, 8, True)]
    left = N.one_of_each(df).collect()
    assert sum(r["doc_id"] == 7 for r in left) == 1 and sum(bool(r["text"]) and r["text"].startswith(b.split()[0] + " ") for r in left) == 1 and len(left) == 4


def test_large_components_are_blocks_of_their_own(spark):
    rows = made(11) + made(12)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute(rows, 5, 80)
    for block in (2, 3, 1000):
        got = N.near_components(documents(spark, rows), N.NearOptions(5, 80, block=block)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_what_stays_on_disk(spark):
    """Only the tables that the lazy result reads are left below the checkpoint folder."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    out = N.near_components(documents(spark, made(3)), N.NearOptions(3, 85))
    assert len(set(os.listdir(folder)) - before) == 2 and out.count() > 0


def test_batches_are_bounded(spark):
    """Shingles leave a task in small batches, and texts reach it in small ones, whatever the texts' lengths."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tableprep.llm.common import batches_of

    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(1500)] + ["", None, "one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["cls", "t"])
    opt = N.NearOptions()
    out = list(N._shingle_rows([batch, batch.slice(0, 0)], opt))
    assert max(b.num_rows for b in out) < N.ROWS + 300
    shingles = N.Shingler(opt.shingle)
    want = [(int(s.view("i8")), i) for i, t in enumerate(texts) for s in shingles(t)]
    assert [x for b in out for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == want

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("word "), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    with batches_of(spark, N.BATCH):
        largest = docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert largest < 3 << 20
    assert spark.conf.get(key, None) == before
