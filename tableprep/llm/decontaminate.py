"""Operator 5 - benchmark decontamination with spaced seeds.

Each mask covers a few tokens and ignores some of them; the hash of the kept tokens is equal in a benchmark item and a
document although the ignored tokens differ. A hit names a diagonal (document position minus item position); around it
the overlap is grown token by token, without gaps, as long as matches outweigh changes, and it counts as a leak when it
holds at least ``min_tokens`` aligned tokens (or the whole of a shorter item) of which ``min_share`` match. The masks
are chosen so that every overlap that counts by the default options has a hit, whatever tokens of it are changed:
``MASKS`` for 13 tokens and more with a fifth of them changed, ``SHORT_MASKS`` for whole items of 8 to 12. Around a hit
the overlap is grown from every match up to a gap no overlap crosses, so it doesn't matter which seed was hit.

Words are split at white space; scripts written without it are cut into characters.

Documents are never shuffled: their masked hashes are tested where they are read, against the hashes of the benchmark
items. The items are brought to the tasks in portions of at most ``PORTION_TOKENS`` tokens, sized by a count made
first; a benchmark within one portion takes one pass, a larger one a pass for each portion, and all of it is tested.

Defined results: null or empty texts have no tokens and no leaks; items with fewer than ``MIN_ITEM`` tokens are too short
to be evidence and match nothing; items shorter than ``min_tokens`` count only whole; repeated rows of either table give
the same leak once for each (document id, item id); rows with a null id keep it; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MASKS = ("1111011", "1110100011", "11000011011", "1110111")
SHORT_MASKS = ("111011", "11010011", "11111")
SPAN = max(map(len, MASKS + SHORT_MASKS))
MIN_ITEM, LONG_ITEM = 8, 13
HITS = 1 << 20      # compared at once
PORTION_TOKENS = 2_000_000      # 16 MB of token hashes
TOKEN = re.compile(r"[^\W_]+")
# Thai, Lao, Myanmar, Khmer, kana, Chinese characters: no spaces between words.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


@dataclass(frozen=True)
class LeakOptions:
    min_tokens: int = 13
    min_share: float = 0.8
    drop: int = 6               # an overlap ends where its score has fallen by this much
    change: int = -2            # score of a changed token; a match counts 1


class Tokens(dict):
    """Texts to arrays of 64-bit token hashes (lower-cased words without what is neither letter nor digit). The dictionary
    holds known words."""

    def __init__(self, most: int = 1 << 20):
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = "".join(TOKEN.findall(word))
        h = self[word] = self.hash(bare) | 1 if bare else 0
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        if not text.isascii() and SPACELESS.search(text):
            text = SPACELESS.sub(r" \g<0> ", text)
        words = text.split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


STEP = [(0x9E3779B97F4A7C15 * (2 * i + 1) | 1) % (1 << 64) for i in range(SPAN)]


def masked(tokens: np.ndarray, masks: list[tuple[str, int]]):
    """(mask, hashes of each position) for each (mask, seed): sums of the kept tokens times odd numbers by their place."""
    times = {}
    for mask, seed in masks:
        n = max(0, len(tokens) - len(mask) + 1)
        h = np.full(n, seed * STEP[1] % (1 << 64), np.uint64)
        for i, c in enumerate(mask):
            if c == "1" and n:
                if i not in times:
                    times[i] = tokens * np.uint64(STEP[i])
                h += times[i][i:i + n]
        h ^= h >> np.uint64(31)
        yield mask, h


def grown(doc: np.ndarray, item: np.ndarray, diagonal: int, at: int, opt: LeakOptions) -> tuple[int, int, int]:
    """(first item position, tokens, matches) of the overlap on the diagonal around item position ``at``."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[lo:hi] == doc[lo + diagonal:hi + diagonal]

    def reach(s: np.ndarray) -> int:
        if not len(s):
            return 0
        score = np.cumsum(np.where(s, 1, opt.change))
        top = np.maximum.accumulate(np.maximum(score, 0))
        stop = np.flatnonzero(top - score >= opt.drop)
        score = score[:stop[0]] if len(stop) else score
        return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0

    right, left = reach(same[at - lo:]), reach(same[:at - lo][::-1])
    start = at - left
    return start, left + right, int(same[start - lo:at + right - lo].sum())


class Index:
    """The masked hashes of a portion of the items, in order, behind a bit table that turns most positions away."""

    def __init__(self, items: list[tuple], opt: LeakOptions):
        self.items, self.opt, self.parts = items, opt, {}
        size = np.array([len(t) for _, t in items], np.int64)
        brief = (size >= MIN_ITEM) & (size < (LONG_ITEM if opt.min_tokens >= LONG_ITEM else np.inf))
        of = {m: np.flatnonzero(size >= LONG_ITEM) for m in MASKS} | {m: np.flatnonzero(brief) for m in SHORT_MASKS}
        self.masks = [(m, i) for i, (m, own) in enumerate(of.items()) if len(own)]
        for mask, seed in self.masks:
            own = [(i, items[i][1]) for i in of[mask].tolist()]
            h = np.concatenate([np.empty(0, np.uint64), *(next(masked(t, [(mask, seed)]))[1] for _, t in own)])
            n = [len(t) - len(mask) + 1 for _, t in own]
            item = np.repeat(np.array([i for i, _ in own], np.int64), n)
            at = np.concatenate([np.empty(0, np.int64), *(np.arange(x) for x in n)])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << max(16, int(8 * len(h)).bit_length()), bool)
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.parts[mask] = h[order], item[order], at[order], bits

    def leaks(self, docs: list[np.ndarray]) -> list[tuple]:
        """(document, item, document position, item position, tokens, matches) of the best leak of each item in each of
        ``docs``. The documents are searched end to end; hits over an end fall away when they are compared."""
        ends = np.cumsum([0, *(len(d) for d in docs)])
        best: dict = {}
        done: dict = {}
        for mask, h in masked(np.concatenate([np.empty(0, np.uint64), *docs]), self.masks):
            keys, items, ats, bits = self.parts[mask]
            maybe = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
            in_doc = np.searchsorted(ends, maybe, "right") - 1
            inside = maybe + len(mask) <= ends[in_doc + 1]
            maybe, in_doc = maybe[inside], in_doc[inside]
            lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            upto = np.cumsum(hi - lo)
            for first in range(0, int(upto[-1]) if len(upto) else 0, HITS):     # the hits by number
                n = np.arange(first, min(first + HITS, int(upto[-1])))
                k = np.searchsorted(upto, n, "right")
                j = hi[k] - (upto[k] - n)
                i, x = items[j], ats[j]
                for hit in zip(in_doc[k].tolist(), i.tolist(), (maybe[k] - ends[in_doc[k]] - x).tolist(), x.tolist(), strict=True):
                    if (spans := done.get(hit[:3])) is None or not any(a <= hit[3] < z for a, z in spans):
                        done.setdefault(hit[:3], []).append(self._tried(docs[hit[0]], *hit, best))
        return [(doc, self.items[i][0], -b[1], -b[2], b[3], b[0]) for (doc, i), b in sorted(best.items())]


    def _tried(self, tokens: np.ndarray, doc: int, i: int, diagonal: int, x: int, best: dict) -> tuple[int, int]:
        """The stretch of item positions around ``x`` that no overlap leaves; leaks in it are put into ``best``."""
        item, opt = self.items[i][1], self.opt
        lo, hi = max(0, -diagonal), min(len(item), len(tokens) - diagonal)
        same = item[lo:hi] == tokens[lo + diagonal:hi + diagonal]
        least = min(opt.min_tokens, len(item))
        if np.count_nonzero(same) < opt.min_share * least:
            return lo, hi
        gap = -(-opt.drop // -opt.change)   # so many changes in a row end any overlap
        seen = np.cumsum(np.concatenate([[0], same]))
        gaps = np.flatnonzero(seen[gap:] == seen[:-gap]) + lo
        at = int(np.searchsorted(gaps, x))
        start, end = int(gaps[at - 1]) + gap if at else lo, int(gaps[at]) if at < len(gaps) else hi
        if np.count_nonzero(same[start - lo:end - lo]) < opt.min_share * least:
            return start, end
        leaks: list[tuple[int, int]] = []
        for y in (np.flatnonzero(same[start - lo:end - lo]) + start).tolist():
            if any(a <= y < z for a, z in leaks):
                continue
            a, n, matched = grown(tokens, item, diagonal, y, opt)
            if n >= least and matched >= opt.min_share * n:
                leaks.append((a, a + n))
                new = (matched, -(a + diagonal), -a, n)
                if (doc, i) not in best or new > best[doc, i]:
                    best[doc, i] = new
        return start, end


LEAK = "doc_start long, item_start long, n_tokens long, n_matched long"


def _portions(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of about PORTION_TOKENS tokens, sized by a count of its characters (a token has one or more)."""
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-size // (2 * PORTION_TOKENS)))
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, opt: LeakOptions = LeakOptions(), id_col: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, doc_start, item_start, n_tokens, n_matched): the best leak of each document and item;
    positions and lengths in tokens."""
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kinds = [df.schema["doc_id"].dataType, benchmark.schema[item_id].dataType]
    schema = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]), *T.StructType.fromDDL(LEAK).fields])
    found = None
    for portion in _portions(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in portion.collect()])

        def run(batches, shared=shared):
            tokens = Tokens()
            index = Index([(i, t) for i, x in shared.value if len(t := tokens(x)) >= MIN_ITEM], opt)
            for b in batches:
                rows, some, size = [], [], 0
                for i, t in enumerate(b.column(1)):     # some hundred thousand tokens at once
                    some.append(tokens(t.as_py()))
                    size += len(some[-1])
                    if size > 500_000 or i == b.num_rows - 1:
                        first = i + 1 - len(some)
                        rows += [(b.column(0)[first + x[0]].as_py(), *x[1:]) for x in index.leaks(some)]
                        some, size = [], 0
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = [b.schema.field(0).type, pa.int64() if isinstance(kinds[1], T.LongType) else None, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if t is not None else pa.array(c) for c, t in zip(cols, types, strict=True)], names=schema.names)

        part = df.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_matched", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "n_tokens")).alias("x")
    one = found.groupBy("doc_id", "item_id").agg(best)      # repeated rows, and portions
    return one.select("doc_id", "item_id", (-F.col("x.d")).alias("doc_start"), (-F.col("x.i")).alias("item_start"),
                      F.col("x.n_tokens").alias("n_tokens"), F.col("x.n_matched").alias("n_matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, opt: LeakOptions = LeakOptions(), text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item leaks, with all their columns; a pass for each portion of the benchmark."""
    at = docs.columns.index(text)
    for portion in _portions(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast([r["text"] for r in portion.collect()])

        def run(batches, shared=shared):
            tokens = Tokens()
            index = Index([(i, t) for i, x in enumerate(shared.value) if len(t := tokens(x)) >= MIN_ITEM], opt)
            for b in batches:
                for first in range(0, b.num_rows, 500):
                    part = b.slice(first, 500)
                    bad = {x[0] for x in index.leaks([tokens(t.as_py()) for t in part.column(at)])}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_spaced_seeds(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_spaced_seeds": op5_spaced_seeds}
ORACLE: dict[str, str] = {}
