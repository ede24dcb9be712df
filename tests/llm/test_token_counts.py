import math

import pytest
import regex
from public_tokenizers import PATTERN

from tableprep.llm import token_counts as C
from tableprep.llm.common import table
from tableprep.llm.packing import default_path

from .helpers import CLASHES, awkward, documents

SF = "/root/testdata/sf0.001"


def brute(pieces, raw):
    best = [(0.0, 0)] + [None] * len(raw)
    for i in range(1, len(raw) + 1):
        for j in range(i):
            if (p := pieces.get(raw[j:i])) is not None:
                new = (best[j][0] + p, best[j][1] - 1)
                best[i] = new if best[i] is None or new > best[i] else best[i]
    return -best[-1][1], best[-1][0]


@pytest.mark.parametrize("words", [["a", "ab", "abc", "abd", "b", ""], ["aaaa", "aaaab", "aaa"], ["é", "éa", "ê"]])
def test_small_tries(words):
    pieces = {bytes([b]): -5.0 for b in range(256)} | {b"ab": -6.0, b"abc": -10.0, b"aa": -10.0, b"aaa": -9.0, "é".encode(): -3.0}
    trie = C.PrefixTrie(pieces)
    trie.insert(words)
    assert trie.terminals == {w: brute(pieces, w.encode()) for w in words}


def test_query_against_single_words(spark):
    pieces, cut = C.zipf_pieces(default_path()), regex.compile(PATTERN).findall
    known: dict = {}
    got = {r["doc_id"]: r for r in C.op3_trie_counts(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for r in docs[:60]:
        words = cut(r["text"] or "")
        for w in words:
            if w not in known:
                known[w] = brute(pieces, w.encode())
        g = got[r["doc_id"]]
        assert (g["n_pretokens"], g["n_tokens"]) == (len(words), sum(known[w][0] for w in words))
        assert math.isclose(g["score"], math.fsum(known[w][1] for w in words), rel_tol=1e-12, abs_tol=1e-9)


def test_awkward_rows(spark):
    df = documents(spark, awkward(), (*CLASHES, "score", "n_tokens"))
    got = C.token_counts(df, default_path()).collect()
    assert len(got) == df.count() and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert len({(r["n_tokens"], r["score"]) for r in got if r["doc_id"] == 5}) == 1
    assert C.token_counts(df.limit(0), default_path()).count() == 0
