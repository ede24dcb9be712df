import itertools
import math
import random

import pytest

from tableprep.llm import decontaminate as D
from tableprep.llm.common import table

from .helpers import CLASHES, awkward, documents, prose

SF = "/root/testdata/sf0.01"


def plain(docs, items, opt=D.LeakOptions()):
    """Every diagonal of every document and item, without seeds."""
    tok, out = D.Tokens(), set()
    for d, t in docs:
        a = tok(t)
        for i, x in items:
            b = tok(x)
            if len(b) < D.MIN_ITEM:
                continue
            for diagonal in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
                same = b[lo:hi] == a[lo + diagonal:hi + diagonal]
                for at in [lo + j for j in range(len(same)) if same[j]][:1 if same.all() else None]:
                    _, n, m = D.grown(a, b, diagonal, at, opt)
                    if n >= min(opt.min_tokens, len(b)) and m >= opt.min_share * n:
                        out.add((d, i))
    return out


def test_leaks_of_the_generated_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.op5_spaced_seeds(spark, SF).collect()}
    flat = {d: " ".join((t or "").lower().split()) for d, t in docs}
    assert {(d, i) for d, t in flat.items() for i, x in items if " ".join(x.lower().split()) in t} <= got
    assert got and {d for d, _ in got} <= {d for d, i in plain([x for x in docs if x[0] in {d for d, _ in got}], items)}


@pytest.mark.parametrize("seed", range(6))
def test_changed_tokens_are_tolerated(spark, seed):
    rng = random.Random(seed)
    item = [f"w{rng.randrange(10 ** 6)}" for _ in range(40)]
    docs = {}
    for k in range(8):
        w = list(item)
        for p in rng.sample(range(40), k):
            w[p] = "changed"
        docs[k] = " ".join([prose(50), *w, prose(50, 4)])
    index = D.Index([(7, D.Tokens()(" ".join(item)))], D.LeakOptions())
    got = {x[0] for x in index.leaks([D.Tokens()(docs[k]) for k in range(8)])}
    want = {d for d, _ in plain(list(docs.items()), [(7, " ".join(item))])}
    assert {0, 1, 2, 3, 4} <= got <= want and len(want - got) <= 1


def fewest_changes(masks, most):
    """For each length the fewest changed tokens, first and last unchanged, that leave no seed of the masks: over all patterns."""
    n = 1 << max(map(len, masks)) - 1      # the last tokens, a bit for each changed one
    keep = [int(m, 2) for m in masks]
    level, out = {n - 1: 0}, {}
    for length in range(1, most + 1):
        then = {}
        for state, count in level.items():
            for changed in (0, 1) if length > 1 else (0,):
                full = state << 1 | changed
                if all(full & k for k in keep):
                    to = full & n - 1
                    then[to] = min(then.get(to, most), count + changed)
        level = then
        out[length] = min((c for s, c in level.items() if not s & 1), default=most)
    return out


def test_every_overlap_that_counts_has_a_seed():
    for masks, lengths in ((D.MASKS, range(13, 151)), (D.SHORT_MASKS, range(8, 13))):
        fewest = fewest_changes(masks, max(lengths))
        for n in lengths:
            assert fewest[n] > n - math.ceil(0.8 * n), (masks, n)


@pytest.mark.parametrize("n", range(8, 17))
def test_every_pattern_of_changes_is_found(n):
    """An item of n tokens, and for 13 and more also a part of a longer item."""
    item = [f"i{j}" for j in range(n)]
    docs = {}
    for c in range(n - math.ceil(0.8 * n) + 1):
        for at in itertools.combinations(range(n), c):
            docs[c, at] = " ".join(["before", "it", *("changed" if j in at else w for j, w in enumerate(item)), "and", "after"])
    for full in [item] + [[*(f"p{j}" for j in range(9)), *item, *(f"q{j}" for j in range(9))]] * (n >= 13):
        index = D.Index([(7, D.Tokens()(" ".join(full)))], D.LeakOptions())
        got = {list(docs)[x[0]] for x in index.leaks([D.Tokens()(t) for t in docs.values()])}
        assert got == {d for d, _ in plain(list(docs.items()), [(7, " ".join(full))])}
        assert {(c, at) for c, at in docs if not {0, 1, 2, n - 3, n - 2, n - 1} & set(at) and c < 2} <= got


@pytest.mark.parametrize("item", ["什么是光合作用的主要产物", "しょくぶつはどこでひかりをつかいますか", "พืชใช้แสงที่ไหน"])
def test_text_without_spaces(item):
    docs = [f"問題：{item}。答え", item, item[:6], "何か別の文章です"]
    index = D.Index([(1, D.Tokens()(item))], D.LeakOptions())
    assert {x[0] for x in index.leaks([D.Tokens()(t) for t in docs])} == {0, 1}


def test_short_items_and_portions(spark, monkeypatch):
    items = [(1, "one two three four five six seven eight nine"), (2, "too short"), (3, prose(40, 2)), (3, prose(40, 2)), (4, None), (None, prose(30, 11))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    rows = [*awkward(2000), (20, f"x {items[0][1]} y too short"), (21, f"{prose(9, 50)} {prose(40, 2).upper()}!"), (22, prose(30, 11)), (22, prose(30, 11))]
    df = documents(spark, rows, (*CLASHES, "item_id", "n_tokens"))
    for most in (2_000_000, 120):
        monkeypatch.setattr(D, "PORTION_TOKENS", most)
        assert (len(D._portions(bench, "item_id", "text")) == 1) == (most > 120)
        got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()}
        assert {(20, 1), (21, 3), (22, None)} <= got and not {d for d, _ in got} & {1, 2, 3}
        left = D.without_leaks(df, bench)
        assert left.columns == df.columns and not {20, 21, 22} & {r["doc_id"] for r in left.collect()}
        assert left.where("doc_id IN (1, 2, 3)").count() == 3
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0
