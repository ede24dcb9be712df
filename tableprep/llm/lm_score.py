"""Operator 1 - n-gram language-model scores from an Elias-Fano trie.

The model is a trie of levels. A level holds, under each context (a node of the level above), the words that follow it, as
one monotone Elias-Fano sequence of context rank * words + word; where a context's successors begin is a second one.
Each entry has a quantised probability, each context a quantised back-off weight. Levels are binary files that
are read memory-mapped; ``Level.find`` takes many n-grams at once: each context's range is read from the pointers, and
the word's successor is searched within it, in the packed sequence. With counts
c, the probability is interpolated: p(w | ctx) = c(ctx w) / (c(ctx) + mu) + mu / (c(ctx) + mu) * p(w | shorter ctx), and
p(w) = (c(w) + 1) / (N + V + 1).

At scale no task holds the trie. Texts are coded in blocks of about ``block_tokens`` tokens; for each level a block sends its
distinct n-grams, once each with its training count, to shards by context. A shard sums the counts of all blocks, builds its part
of the level and answers the blocks' n-grams from it, in the order they came. A context with more than
``split_count`` training tokens is dealt over several shards by the next word, its total sent along, so no shard holds
a hot context. Everything is counted over all training documents; the number of shards follows the input.

Words are known by 64-bit hashes. Defined results: null or blank text is its end token alone; a null id counts as the
empty text in the split and stays null; repeated rows count and are scored as often as they occur; without training
documents N = V = 0 and every token has probability 1; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import shuffles_removed, table, written

@dataclass(frozen=True)
class LmOptions:
    order: int = 3
    mu: tuple[float, ...] = (0.0, 400.0, 20.0)      # by level, from the first
    block_tokens: int = 1_000_000
    shard_items: int = 250_000
    split_count: int = 250_000
    steps: int = 255            # levels of a quantised value, over 12 decades

    def __post_init__(self):
        if not 1 <= self.order <= len(self.mu):
            raise ValueError("mu needs a value for each level up to order")


# ------------------------------------------------------------------------------------------- Elias-Fano

class EliasFano:
    """A monotone sequence: low bits packed into 64-bit words, high bits in unary. All parts are arrays, so they can be
    memory-mapped."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.ranks = n, low_bits, lows, highs, ranks
        self.places = None      # of the ones in the unary part, once many values are asked for

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        lows = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            low = v & np.uint64((1 << bits) - 1)
            at = np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lows[word[first]] = np.add.reduceat(low << shift, first)
            over = np.flatnonzero((at & 63) + bits > 64)        # at most one value for each word end
            lows[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        unary = np.zeros((int(v[-1] >> np.uint64(bits)) + n + 1) if n else 1, np.uint8)
        unary[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        highs = np.packbits(unary)
        ones = np.bitwise_count(np.pad(highs, (0, -len(highs) % 64))).reshape(-1, 64).sum(1, dtype=np.int64)
        return cls(n, bits, lows, highs, np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.lows[word] >> shift
        over = np.flatnonzero((at & 63) + self.low_bits > 64)
        out[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def _select(self, i: np.ndarray) -> np.ndarray:
        """The places of the i-th ones: by ranks of 512-bit parts for a few, by one pass over the unary part for many."""
        if self.places is None and len(i) > 64:
            self.places = np.flatnonzero(np.unpackbits(self.highs))
        if self.places is not None:
            return self.places[i]
        part = np.searchsorted(self.ranks, i, "right") - 1
        return np.array([p * 512 + np.flatnonzero(np.unpackbits(self.highs[p * 64:p * 64 + 64]))[x - self.ranks[p]] for p, x in zip(part.tolist(), i.tolist(), strict=True)], np.int64)

    def get(self, i) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        return (self._select(i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def at_least(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Successor search, many at once: the first position in [lo, hi) whose value isn't below ``want``, else hi. Each step
        halves the ranges that are left."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.get(mid) < want[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.lows, self.highs, self.ranks]


# ------------------------------------------------------------------------------------------- levels

def quantised(p: np.ndarray, steps: int) -> np.ndarray:
    """Probabilities to codes 1 to ``steps``, even in the logarithm over 12 decades; 0 stands for none."""
    with np.errstate(divide="ignore"):
        x = np.rint((steps - 1) * (1 + np.log10(p) / 12)) + 1
    return np.where(p > 0, np.clip(x, 1, steps), 0).astype(np.uint16)


def restored(code: np.ndarray, steps: int) -> np.ndarray:
    every = np.arange(steps + 1, dtype=np.float64)
    return np.where(every > 0, 10.0 ** (12 * ((every - 1) / (steps - 1) - 1)), 0.0)[code]


class Level:
    """Contexts, where their successors begin, the successors, counts and codes; from a memory-mapped file."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, words: int, codes, weights, counts):
        self.contexts, self.pointers, self.successors, self.words = contexts, pointers, successors, words
        self.codes, self.weights, self.counts = codes, weights, counts

    @classmethod
    def build(cls, ctx: np.ndarray, word: np.ndarray, count: np.ndarray, totals: dict[int, int], mu: float, steps: int) -> Level:
        """From distinct (ctx, word), sorted, with counts over 0. totals: of contexts that other shards share."""
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, np.int64)
        names = ctx[first]
        total = np.add.reduceat(count, first) if len(first) else np.empty(0, np.int64)
        for i, x in enumerate(names.tolist()) if totals else ():
            total[i] = totals.get(x, total[i])
        rank = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(ctx)]]).astype(np.int64)))
        words = int(word.max()) + 1 if len(word) else 1
        return cls(EliasFano.of(names), EliasFano.of(first), EliasFano.of(rank.astype(np.uint64) * np.uint64(words) + word.astype(np.uint64)), words,
                   quantised(count / (total[rank] + mu), steps), quantised(mu / (total + mu), steps), _narrow(count))

    def write(self, f) -> None:
        arrays = [x for e in (self.contexts, self.pointers, self.successors) for x in e.parts()]
        for x in [*arrays, np.array([self.words], np.int64), self.codes, self.weights, self.counts]:
            x = np.ascontiguousarray(x)
            f.write(x.dtype.str.encode().ljust(8) + len(x).to_bytes(8, "little") + x.tobytes() + bytes(-x.nbytes % 8))
        f.flush()

    @classmethod
    def mapped(cls, f) -> Level:
        """The level of a file written by ``write``; its arrays stay in the file."""
        got, at = [], 0
        for _ in range(16):
            f.seek(at)
            head = f.read(16)
            kind, n = np.dtype(head[:8].decode().strip()), int.from_bytes(head[8:], "little")
            got.append(np.memmap(f, kind, "r", offset=at + 16, shape=(n,)) if n else np.empty(0, kind))
            at += 16 + n * kind.itemsize + -n * kind.itemsize % 8
        e = [EliasFano(int(got[i][0]), int(got[i][1]), *got[i + 1:i + 4]) for i in (0, 4, 8)]
        return cls(*e, int(got[12][0]), *got[13:16])

    def find(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of n-grams, -1 where there is none: a context by bisection; its range by the pointers; in the range the
        first successor that isn't smaller than the word, relative to the context. Runs of equal contexts are looked up once."""
        if not len(ctx) or not self.contexts.n:
            return np.full(len(ctx), -1)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        names = ctx[first].astype(np.uint64)
        n = self.contexts.n
        rank = np.searchsorted(self.contexts.all(), names)
        inside = np.minimum(rank, n - 1)
        known = (rank < n) & (self.contexts.get(inside) == names)
        begin = self.pointers.get(inside).astype(np.int64)
        after = np.where(inside + 1 < n, self.pointers.get(np.minimum(inside + 1, n - 1)).astype(np.int64), self.successors.n)
        own = np.cumsum(np.concatenate([[0], (ctx[1:] != ctx[:-1]).astype(np.int64)]))
        ok = known[own] & (word < self.words)
        own = own[ok]
        want = inside[own].astype(np.uint64) * np.uint64(self.words) + word[ok].astype(np.uint64)
        at = self.successors.at_least(begin[own], after[own], want)
        hit = np.minimum(at, self.successors.n - 1)
        out = np.full(len(ctx), -1)
        out[ok] = np.where((at < after[own]) & (self.successors.get(hit) == want), at, -1)
        return out


# ------------------------------------------------------------------------------------------- blocks

def _zip(*arrays: np.ndarray) -> bytes:
    import zstandard

    out = []
    for x in arrays:    # byte by byte: the high bytes of small numbers compress to nothing
        x = np.ascontiguousarray(x)
        out.append(x.dtype.str.encode().ljust(8) + len(x).to_bytes(8, "little") + x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unzip(raw: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for _ in range(n):
        kind, size = np.dtype(raw[at:at + 8].decode().strip()), int.from_bytes(raw[at + 8:at + 16], "little")
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at + 16).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 16 + size * kind.itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences in the narrowest type."""
    d = np.diff(x, prepend=np.int64(0))
    return _narrow(d)


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not len(x) or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(np.int64)


END = xxhash.xxh3_64_intdigest(b"")        # the end token is the empty word


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of all texts, the words of all texts as places among them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    # white space at either end of a text makes an empty word
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = codes != empty
    lens = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]])
    words = coded.dictionary.cast(pa.large_binary())
    _, begin, data = words.buffers()
    data = memoryview(data or b"")
    begin = np.frombuffer(begin, np.int64)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else [0]
    h = np.fromiter((xxhash.xxh3_64_intdigest(data[a:z]) for a, z in itertools.pairwise(begin)), np.uint64, len(words))
    return h, codes[real], lens


def _blocks(batches, size: int):
    """Rows (block, ids, lens, train, data): lens and train for each document; data: word hashes and local tokens."""
    base, number = TaskContext.get().partitionId() << 32, 0
    ids, lens, train, tokens, hashes, n = [], [], [], [], [], 0

    def done(kind):
        # each portion has words of its own, equal ones are found by hash
        h, same = np.unique(np.concatenate(hashes), return_inverse=True)
        upto = np.cumsum([0, *map(len, hashes)])
        tok = np.concatenate([same[a:z][t] for t, a, z in zip(tokens, upto[:-1], upto[1:], strict=True)])
        uses = np.bincount(tok, minlength=len(h))
        order = np.argsort(-uses, kind="stable")        # frequent words get small numbers
        new = np.empty(len(h), np.int64)
        new[order] = np.arange(len(h))
        many = np.concatenate(lens)
        learn = np.array(train, bool)
        return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([ids], pa.list_(kind)), pa.array([many], pa.list_(pa.int64())),
                                           pa.array([train], pa.list_(pa.bool_())), pa.array([_zip(h[order].view(np.int64), _narrow(new[tok]))], pa.binary()),
                                           pa.array([len(h)]), pa.array([n]), pa.array([int(many[learn].sum())])],
                                          names=["block", "ids", "lens", "train", "data", "n_words", "n_tokens", "n_train"])

    kind = pa.int64()
    for b in batches:
        kind = b.schema.field(0).type
        if not b.num_rows:
            continue
        named, codes, sizes = _coded(b.column(1))
        keys, learns = b.column(0).to_pylist(), b.column(2).to_pylist()
        upto = np.cumsum(sizes + 1)         # with the end token of each text
        begins = np.cumsum(sizes) - sizes
        at = 0
        while at < b.num_rows:      # texts until the block is full
            to = min(b.num_rows, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size - n)) + 1)
            mine, count = codes[begins[at]:begins[to - 1] + sizes[to - 1]], sizes[at:to]
            used = np.zeros(len(named), bool)
            used[mine] = True
            local = np.cumsum(used)
            hashes.append(np.concatenate([np.array([END], np.uint64), named[used]]))
            out = np.zeros(len(mine) + to - at, np.int64)       # the end token is 0
            is_end = np.zeros(len(out), bool)
            is_end[np.cumsum(count + 1) - 1] = True
            out[~is_end] = local[mine]
            tokens.append(out)
            ids += keys[at:to]
            lens.append(count + 1)
            train += map(bool, learns[at:to])
            n += len(out)
            at = to
            if n >= size:
                yield done(kind)
                number += 1
                ids, lens, train, tokens, hashes, n = [], [], [], [], [], 0
    if ids:
        yield done(kind)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and, for each key, its place among them: one sort of keys with their places below, where both fit
    into 63 bits."""
    n = len(keys)
    place = max(1, n.bit_length())
    if not n or int(keys.max()).bit_length() + place > 63:
        return np.unique(keys, return_inverse=True)
    packed = np.sort(keys << place | np.arange(n))
    ordered, at = packed >> place, packed & ((1 << place) - 1)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    inverse = np.empty(n, np.int64)
    inverse[at] = np.cumsum(new) - 1
    return ordered[new], inverse


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers from 0 in order, and for each pair its place among them."""
    bits = max(1, int(b.max()).bit_length()) if len(b) else 1
    if not len(a) or int(a.max()).bit_length() + bits <= 63:
        keys, same = _distinct(a << bits | b)
        return keys >> bits, keys & ((1 << bits) - 1), same
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    same = np.empty(len(a), np.int64)
    same[order] = np.cumsum(new) - 1
    return x[new], y[new], same


class Block:
    """A block's tokens and, level by level, its n-grams and what the shards answered."""

    def __init__(self, row: dict, opt: LmOptions, shards: list[int]):
        self.opt, self.shards = opt, shards
        self.hashes, tok = _unzip(row["data"], 2)
        self.tok = tok.astype(np.int64)
        self.lens = np.array(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.learn = np.repeat(np.array(row["train"], bool), self.lens)
        self.place = np.arange(len(self.tok)) - np.repeat(self.ends - self.lens, self.lens)     # within the document
        self.level, self.gram = 0, None

    def items(self, send: bool = True):
        """The next level's distinct n-grams by (shard, context, word): (shard, context, word, count, total). Words and n-grams
        are numbered here as their global names order, so equal ones are found, and sorted, by one sort of (context, word).
        Without ``send`` only what taking the answers needs: which n-grams were sent, in which order, to which shards."""
        opt, n = self.opt, len(self.hashes)
        self.level += 1
        if self.level == 1:
            self.gram, uses = self.tok, np.bincount(self.tok[self.learn], minlength=n)
            ctx, word, total = np.zeros(n, np.int64), self.hashes, np.zeros(n, np.int64)
            shard = (self.hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % self.shards[0]
            self.own = np.arange(n)
            self.order = np.lexsort((word, shard))
        else:
            ok = np.flatnonzero(self.place >= self.level - 1)       # the n-gram before ends one token earlier in the same text
            bits = max(1, (n - 1).bit_length())
            keys, inverse = _distinct(self.gram[ok - 1] << bits | self.tok[ok])
            self.gram = np.full(len(self.tok), -1)
            self.gram[ok] = inverse
            self.has = ok
            self.parent, local = keys >> bits, keys & ((1 << bits) - 1)
            ctx, word, total = self.node[self.parent], self.word[local], self.count[self.parent]
            self.own = np.flatnonzero((ctx > 0) & (word > 0))
            ctx, word, total = ctx[self.own], word[self.own], total[self.own]
            h = ctx.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            hot = np.flatnonzero(total >= opt.split_count)      # dealt by the next word
            h[hot] += (word[hot] % (1 + total[hot] // opt.split_count)).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)).view(np.int64)
            shard = h - h // self.shards[self.level - 1] * self.shards[self.level - 1]
            self.order = np.argsort(_narrow(shard), kind="stable")      # within a shard they are sorted already
            if send:
                total = np.where(total >= opt.split_count, total, 0)
                uses = np.bincount(inverse[self.learn[ok]], minlength=len(keys))[self.own]
        self.at = shard[self.order]
        if not send:
            return None
        self.sent = [x[self.order] for x in (shard, ctx, word, uses.astype(np.int64), total)]
        return self.sent

    def messages(self):
        """(shard, bytes) of the next level."""
        shard, ctx, word, uses, total = self.items()
        cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            first = np.flatnonzero((total[a:z] > 0) & np.concatenate([[True], ctx[a + 1:z] != ctx[a:z - 1]]))
            yield int(shard[a]), _zip(_steps(ctx[a:z]), word[a:z] if self.level == 1 else _narrow(word[a:z]), _narrow(uses[a:z]), ctx[a:z][first], total[a:z][first])

    def take(self, answers: list[tuple[int, bytes]], n: int, types: int) -> None:
        """The shards' answers for the level whose ``items`` were made last; n, types: N and V."""
        opt, last = self.opt, self.level == self.opt.order
        got = {s: _unzip(raw, 3) for s, raw in answers}
        cuts = self.at[np.concatenate([[True], self.at[1:] != self.at[:-1]])] if len(self.at) else self.at
        node, count, code = (np.concatenate([np.empty(0, np.int64), *(got[s][i].astype(np.int64) for s in cuts.tolist())]) for i in range(3))
        if not last:    # places come as steps
            node = np.concatenate([np.empty(0, np.int64), *(np.cumsum(got[s][0].astype(np.int64)) for s in cuts.tolist())])
            found = count > 0
            node = np.where(found, (node * self.shards[self.level - 1] + self.at) + 1, 0)
        size = len(self.hashes) if self.level == 1 else int(self.gram.max()) + 1 if len(self.gram) else 0
        full = [np.zeros(size, np.int64) for _ in range(3)]
        to = self.own[self.order]
        for f, x in zip(full, (node, count, code), strict=True):
            if len(x):
                f[to] = x
        if self.level == 1:
            by = np.argsort(full[0])     # from here on words are numbered by their global names
            rank = np.empty(size, np.int64)
            rank[by] = np.arange(size)
            self.tok = self.gram = rank[self.tok]
            self.word, self.c = full[0][by], full[1][by]
            self.node, self.count = self.word, self.c
            self.p = ((self.c + 1) / (n + types + 1))[self.tok]
        else:
            # weight of the context; a context that training doesn't have leaves the shorter one's probability
            has = self.has
            mu = opt.mu[self.level - 1]
            g = self.gram[has]
            # once for each context, then for the n-grams under it
            weight = np.where(self.count > 0, restored(quantised(mu / (self.count + mu), opt.steps), opt.steps), 1.0)[self.parent]
            self.p[has] = restored(full[2], opt.steps)[g] + weight[g] * self.p[has]
            if not last:
                by = np.argsort(full[0])
                rank = np.empty(size, np.int64)
                rank[by] = np.arange(size)
                self.gram[has] = rank[g]
                self.node, self.count = full[0][by], full[1][by]


def _block_of(rows, opt: LmOptions, shards: list[int], n: int, types: int):
    """The block of one row (its columns, and answers: level, shard, data), with all answers taken."""
    block = Block(rows, opt, shards)
    for level in range(1, len(shards)):
        block.items(send=False)
        block.take([(a["shard"], a["data"]) for a in rows["answers"] if a["level"] == level], n, types)
    return block


# ------------------------------------------------------------------------------------------- shards

def _answer(key, group: pa.Table, level: int, opt: LmOptions) -> pa.Table:
    """Builds a shard's part of a level from all blocks' n-grams and answers each block."""
    raws = [(b, raw, _unzip(raw, 5)) for b, raw in zip(group["block"].to_pylist(), group["data"].to_pylist(), strict=True)]
    every = [(np.cumsum(x[0].astype(np.int64)), x[1].astype(np.int64) if level > 1 else x[1], x[2].astype(np.int64)) for _, _, x in raws]
    totals = {int(c): int(t) for _, _, x in raws for c, t in zip(x[3], x[4], strict=True)}
    ctx, word, uses = (np.concatenate([e[i] for e in every]) for i in range(3))
    cuts = np.cumsum([0, *(len(e[1]) for e in every)])
    if level == 1:      # hashes in the order of unsigned numbers, which the sequences need; contexts of one entry each
        ctx, same = np.unique(word.view(np.uint64), return_inverse=True)
        word = np.zeros(len(ctx), np.int64)
    else:
        ctx, word, same = _distinct_pairs(ctx, word)
    # what blocks have in common is counted, and looked up, once
    count = np.bincount(same, weights=uses, minlength=len(ctx)).astype(np.int64)
    learnt = count > 0
    part = Level.build(ctx[learnt], word[learnt], count[learnt], totals, opt.mu[level - 1], opt.steps)
    out = []
    with tempfile.TemporaryFile() as f:
        part.write(f)
        part = Level.mapped(f)
        places = part.find(ctx, word)
        codes, counts = np.asarray(part.codes), np.asarray(part.counts)
        code = np.where(places >= 0, codes[places], 0) if len(codes) else np.zeros(len(places), np.int64)
        n = np.where(places >= 0, counts[places], 0) if len(counts) else np.zeros(len(places), np.int64)
        empty = np.empty(0, np.int8)
        for (b, _, _), a, z in zip(raws, cuts[:-1], cuts[1:], strict=True):
            at = same[a:z]
            if level == opt.order and level > 1:    # nothing goes on from here: only the codes count
                out.append((b, _zip(empty, empty, _narrow(code[at]))))
            else:
                out.append((b, _zip(_steps(places[at]), _narrow(n[at]), _narrow(code[at]))))
        n_types = len(codes)
        del part
    m = len(out)
    return pa.table({"block": pa.array([x[0] for x in out] + [-1], pa.int64()), "level": pa.array([level] * (m + 1), pa.int32()),
                     "shard": pa.array([key[0].as_py()] * (m + 1), pa.int64()), "data": pa.array([x[1] for x in out] + [None], pa.binary()),
                     "n_types": pa.array([0] * m + [n_types], pa.int64())})


def _by_block(df: DataFrame) -> DataFrame:
    """``df`` written once below the checkpoint folder, in buckets by block: what is joined to it by block later is shuffled, the
    blocks themselves never are."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df.write.bucketBy(n, "block").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")     # the name only: the files are outside of the warehouse
    return out


def _two(f):
    """``f`` with exactly the two arguments that applyInArrow looks for."""
    return lambda key, group: f(key, group)


def score(docs: DataFrame, train_on: Column, opt: LmOptions = LmOptions(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns
    from the rows where ``train_on`` holds and scores all."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), train_on.alias("learn"))
    kind = df.schema["id"].dataType.simpleString()
    blocks = _by_block(df.mapInArrow(lambda b: _blocks(b, opt.block_tokens),
                     f"block long, ids array<{kind}>, lens array<long>, train array<boolean>, data binary, n_words long, n_tokens long, n_train long"))
    size = blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first()
    n_words, n_tokens, n_train = (x or 0 for x in size)
    shards = [max(8, -(-n_words // opt.shard_items))] + [max(8, -(-n_tokens // opt.shard_items))] * (opt.order - 1)
    rows, types = blocks.withColumn("answers", F.array().cast("array<struct<level:int,shard:bigint,data:binary>>")), 0
    answers = None
    for level in range(1, opt.order + 1):
        known = shards[:level]

        def send(batches, known=known, types=types):
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1).to_pylist()[0]
                    got = list(_block_of(row, opt, known, n_train, types).messages())
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([row["block"]] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())],
                                                     names=["shard", "block", "data"])

        def answer(key, group, level=level):
            return _answer(key, group, level, opt)

        sent = rows.select("block", "lens", "train", "data", "answers").mapInArrow(send, "shard long, block long, data binary")
        with shuffles_removed(docs.sparkSession):
            new = written(sent.groupBy("shard").applyInArrow(_two(answer),
                          "block long, level int, shard long, data binary, n_types long"))
        if level == 1:
            types = new.agg(F.sum("n_types")).first()[0] or 0
        new = new.where("block >= 0").select("block", "level", "shard", "data")
        answers = new if answers is None else answers.unionByName(new)
        of_block = answers.groupBy("block").agg(F.collect_list(F.struct("level", "shard", "data")).alias("answers"))
        rows = blocks.join(of_block, "block", "left")

    def finish(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _block_of(row, opt, [*shards, 0], n_train, types)
                starts = block.ends - block.lens
                base = np.log10((block.c + 1) / (n_train + types + 1))
                sums = [np.add.reduceat(x, starts) for x in ((block.c > 0).astype(np.int64)[block.tok], base[block.tok], np.log10(block.p))]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("ids"))[i].values, pa.array([not x for x in row["train"]]), pa.array(block.lens), pa.array(sums[0]),
                                                  pa.array(np.full(len(starts), n_train, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                                                 names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = rows.mapInArrow(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op1_elias_fano_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return score(docs, rest != 2)


QUERIES = {"op1_elias_fano_scores": op1_elias_fano_scores}
ORACLE: dict[str, str] = {}     # logarithms summed in another order; see tests/llm/test_lm_score.py
