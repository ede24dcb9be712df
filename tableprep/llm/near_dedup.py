"""Operator 6 - MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct word shingles (64-bit hashes). Its signature has ``k`` symbols of ``b`` bits, the low bits of
``k`` minimum hashes; two sets of similarity J differ in about (1 - J) k symbols, and ``radius`` is the least distance that
a pair at the threshold exceeds with a probability below ``miss``. The signature is split into ``m = radius // 2 + 1``
chunks: by the pigeonhole principle two signatures within the radius have a chunk with at most one error. The allowed
errors are enumerated by leaving out each symbol of a chunk in turn, so every pair within the radius shares a key.

Documents with equal sets are one class from the start. Keys are shuffled as (key, class) rows of 16 bytes; only classes
that share a key go on. Of those, the shingles found in no other such class are counted: they are in no
intersection, so with u of n shingles alone, a pair's intersection is at most min(n1 - u1, n2 - u2), and pairs that can't reach
the threshold by this bound, by their sizes or by the signature distance aren't looked at. Heavily edited copies have many
shingles of their own, so a large group of them makes few pairs, and none that could be a link is lost.

Candidates are made without the pairs of a group: first each key's members (of one size step) are paired with the
smallest class; pairs are confirmed on the full sets, and links give components. Then members of *different* components that
still share a key are compared in blocks, on their full sets too. A pair left out lies in one component already, so
the components are those of all links within the radius.

Defined results: a null or blank text has an empty set and links with nothing; a document with fewer words than a
shingle has its whole word sequence as one shingle; repeated rows are a row each; rows with a null id form
components by the ids they are linked with (a null is never the smallest; a component of null ids alone has a null
name); rows that share an id but not a text are documents of their own, linked each by its text; further columns are
ignored or kept as asked.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batches_of, table, words

PLANES = 8      # bits of a symbol that the distance looks at
BATCH = "2m"    # of rows with texts that a task hands to Python at once
ROWS = 1 << 17  # shingles that a task returns at once, and those of one more text
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class NearOptions:
    shingle: int = 5
    percent: int = 80       # links need 100 * intersection >= percent * union
    k: int = 64             # symbols of a signature
    miss: float = 2e-4      # of a pair exactly at the threshold to be beyond the radius
    block: int = 256        # classes of a group that are compared with as many others in one task

    @property
    def radius(self) -> int:
        p, tail = 1 - self.percent / 100, 1.0
        for r in range(self.k):
            tail -= math.comb(self.k, r) * p**r * (1 - p) ** (self.k - r)
            if tail < self.miss:
                return r
        return self.k

    @property
    def chunks(self) -> list[tuple[int, int]]:
        m = min(self.k, self.radius // 2 + 1)
        cuts = [self.k * i // m for i in range(m + 1)]
        return list(zip(cuts[:-1], cuts[1:], strict=True))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts to the sorted distinct 64-bit hashes of their shingles; words are hashed once a task while the cache holds."""

    def __init__(self, n: int):
        import xxhash

        self.n, self.words, self.hash = n, {}, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            return np.array([self.hash(b" ".join(words), seed=1)], np.uint64)
        h = np.fromiter(map(self.hash, words), np.uint64, len(words))
        out = np.zeros(len(words) - self.n + 1, np.uint64)
        for i in range(self.n):
            out = _mix(out ^ (h[i:len(h) - self.n + 1 + i] + np.uint64(0x9E3779B97F4A7C15)))
        return np.unique(out)


def signatures(docs: DataFrame, opt: NearOptions, id_col: str, text: str) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, digest, sig, planes): digest names the whole set, sig holds k 16-bit symbols, planes
    their low PLANES bits, bit by bit, in longs of 64 symbols."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    rng = np.random.default_rng(20011)
    mult = (rng.integers(0, 1 << 63, opt.k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 1 << 63, opt.k, dtype=np.uint64)

    def run(batches):
        shingles = Shingler(opt.shingle)
        for b in batches:
            n, digest, sigs, planes = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = np.full(opt.k, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 2048):
                    part = s[at:at + 2048]
                    low = np.minimum(low, [(part * m + a).min() for m, a in zip(mult, add, strict=True)])
                low = _mix(low)
                sigs.append((low & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if len(s) else None)
                bits = (low[None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
                bits = np.pad(bits, ((0, 0), (0, -opt.k % 64)))
                planes.append(np.packbits(bits, axis=1).view(np.int64).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(planes, pa.list_(pa.int64()))],
                                             names=["doc_id", "text_hash", "n_shingles", "digest", "sig", "planes"])

    schema = T.StructType([df.schema["doc_id"], *T.StructType.fromDDL("text_hash long, n_shingles long, digest binary, sig binary, planes array<long>").fields])
    return df.mapInArrow(run, schema)


def chunk_keys(classes: DataFrame, opt: NearOptions) -> DataFrame:
    """Rows (key, cls): for each chunk of the signature, the chunk without one of its symbols in turn."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, opt.k).astype(np.uint64)
            keys = []
            for c, (a, z) in enumerate(opt.chunks):
                for out in range(a, z) if z - a > 1 else [-1]:
                    h = np.full(len(sig), (c << 16 | (out + 1)) + 1, np.uint64)
                    for i in range(a, z):
                        if i != out:
                            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, i])
                    keys.append(h)
            m = np.stack(keys, 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), m.shape[1])))], names=["key", "cls"])

    kind = classes.schema["cls"].dataType.simpleString()
    return classes.select("cls", "sig").mapInArrow(run, f"key long, cls {kind}")


def _near(a, b, opt: NearOptions) -> Column:
    """Whether two classes can be a link: by the size of the largest possible intersection, and the distance of their
    signatures, where a symbol differs if any of its planes does. a, b: functions from a name (n, u, planes) to its column."""
    longs = -(-opt.k // 64)
    differ = [reduce(lambda x, y: x.bitwiseOR(y), [a("planes")[p * longs + i].bitwiseXOR(b("planes")[p * longs + i]) for p in range(PLANES)]) for i in range(longs)]
    distance = reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ])
    both = F.least(a("n") - a("u"), b("n") - b("u"))
    return (100 * both >= opt.percent * (a("n") + b("n") - both)) & (distance <= opt.radius)


def _shingle_rows(batches, opt: NearOptions):
    shingles = Shingler(opt.shingle)
    for b in batches:
        at, sets, size = 0, [], 0
        for i, t in enumerate(b.column(1), 1):
            sets.append(shingles(t.as_py()))
            size += len(sets[-1])
            if size >= ROWS or i == b.num_rows:
                of = np.repeat(np.arange(at, i), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), b.column(0).take(pa.array(of))], names=["shingle", "cls"])
                at, sets, size = i, [], 0


def lone_shingles(texts: DataFrame, opt: NearOptions) -> DataFrame:
    """Rows (cls, u): how many of a class's shingles no other class of ``texts`` (cls, t) has."""
    kind = texts.schema["cls"].dataType.simpleString()
    rows = texts.select("cls", "t").mapInArrow(lambda b: _shingle_rows(b, opt), f"shingle long, cls {kind}")
    lone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).where("n = 1")
    return lone.groupBy("cls").agg(F.count("*").alias("u"))


def confirmed(pairs: DataFrame, texts: DataFrame, opt: NearOptions) -> DataFrame:
    """The pairs (a, b) of classes of ``texts`` (cls, t) whose full sets reach the threshold."""
    two = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches):
        shingles, last, of_last = Shingler(opt.shingle), None, None
        for b in batches:
            keep = []
            for x, tx, ty in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if x != last:       # pairs come sorted by their second document
                    last, of_last = x, shingles(ty.as_py())
                sx = shingles(tx.as_py())
                both = len(np.intersect1d(sx, of_last, assume_unique=True))
                keep.append(both > 0 and 100 * both >= opt.percent * (len(sx) + len(of_last) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return two.select("a", "b", "ta", "tb").mapInArrow(run, pairs.select("a", "b").schema)


def _compared(group: pa.Table, opt: NearOptions) -> pa.Table:
    """Links between the components in one block, or two (``side`` 0 and 1): the fewest that join what is to be joined."""
    cls, comp, side = (group[x].to_pylist() for x in ("cls", "c", "side"))
    n = np.array(group["n"].to_pylist(), np.int64)
    planes = np.array(group["planes"].to_pylist(), np.int64).reshape(len(cls), PLANES, -1)
    shingles = Shingler(opt.shingle)
    sets = [shingles(t.as_py()) for t in group["t"]]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    here = np.zeros(len(flat) + 1, bool)
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out, two, where = [], len(set(side)) > 1, np.array(side)
    for x in range(len(cls)):
        if two and side[x]:
            continue
        later = where == 1 if two else np.arange(len(cls)) > x
        differ = np.bitwise_or.reduce(planes ^ planes[x], axis=1)
        distance = np.bitwise_count(differ.view(np.uint64)).sum(axis=1)
        maybe = np.flatnonzero(later & (distance <= opt.radius) & (100 * np.minimum(n, n[x]) >= opt.percent * np.maximum(n, n[x])))
        maybe = [y for y in maybe.tolist() if find(comp[y]) != find(comp[x])]
        if not maybe:
            continue
        mine = flat[starts[x]:starts[x] + n[x]]
        here[mine] = True
        for y in maybe:
            if find(comp[y]) == find(comp[x]):
                continue
            both = int(here[flat[starts[y]:starts[y] + n[y]]].sum())
            if 100 * both >= opt.percent * (int(n[x]) + int(n[y]) - both):
                out.append((cls[x], cls[y]))
                root[find(comp[y])] = find(comp[x])
        here[mine] = False
    kind = group.schema.field("cls").type
    return pa.table({"a": pa.array([max(p) for p in out], kind), "b": pa.array([min(p) for p in out], kind)})


def _across(m: DataFrame, about: DataFrame, texts: DataFrame, opt: NearOptions, scratch: Scratch) -> DataFrame:
    """Links between different components that share a key and size step; m: rows (key, step, cls, c).

    Components that share one are a group. Its classes are dealt by hashes into blocks of about ``opt.block``, those of a large
    component into blocks of their own, and each pair of blocks that holds different components is compared in one task: a
    pair of classes is never a row, a task holds two blocks whatever the group's size, and only links leave it."""
    lo = m.groupBy("key", "step").agg(F.min("c").alias("b"))
    edges = m.join(lo, ["key", "step"]).select(F.col("c").alias("a"), "b").where("a <> b").distinct()
    groups = components(edges, scratch).withColumnsRenamed({"id": "c", "component": "g"})
    one = m.select("cls", "c").distinct().join(groups, "c")
    sizes = one.groupBy("g", "c").agg(F.count("*").alias("size"))
    large = F.col("size") > opt.block
    small = sizes.where(~large).groupBy("g").agg(F.sum("size").alias("others"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / opt.block)).cast("long")
    of_large = F.concat_ws(":", "c", F.pmod(F.xxhash64("cls"), parts("size")))
    of_small = F.concat(F.lit("-:"), F.pmod(F.xxhash64("c"), parts("others")))
    one = one.join(sizes, ["g", "c"]).join(small, "g", "left").withColumn("block", F.when(large, of_large).otherwise(of_small)).select("g", "c", "cls", "block")
    one = scratch.write(one)
    blocks = one.groupBy("g", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    pairs = blocks.join(blocks.toDF("g", "block2", "lo2", "hi2"), "g").where("block <= block2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)").select("g", "block", "block2")
    left = pairs.join(one, ["g", "block"]).withColumn("side", F.lit(0))
    right = pairs.where("block < block2").join(one.withColumnRenamed("block", "block2"), ["g", "block2"]).withColumn("side", F.lit(1))
    rows = left.unionByName(right).join(about.select("cls", "n", "planes"), "cls").join(texts, "cls")
    kind = m.schema["cls"].dataType.simpleString()
    return rows.groupBy("g", "block", "block2").applyInArrow(lambda t: _compared(t, opt), f"a {kind}, b {kind}")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, component): the smallest id reachable over ``links`` (a, b).

    Alternates hooking every id to its smallest neighbour and following labels twice, until nothing changes (labels only
    fall); each round is a written table that takes the place of the one before, and a component of diameter d needs about
    log d rounds."""
    scratch = scratch or Scratch()
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("u", "v"))
    label = scratch.write(both.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("id"), F.least("u", "l").alias("l")))
    before = None
    while True:
        near = both.join(label.withColumnsRenamed({"id": "v", "l": "lv"}), "v").groupBy("u").agg(F.min("lv").alias("m"))
        one = label.join(near.withColumnRenamed("u", "id"), "id").select("id", F.least("l", "m").alias("m"), "l")
        # the smallest label any member of a label has seen is taken over by all its members
        root = one.groupBy("l").agg(F.min("m").alias("r"))
        hooked = one.join(root, "l").select("id", F.least("m", "r").alias("l"))
        jump = hooked.select(F.col("id").alias("l"), F.col("l").alias("l2"))
        last, label = label, scratch.write(hooked.join(jump, "l", "left").select("id", F.least("l", F.coalesce("l2", "l")).alias("l")))
        now = label.agg(F.sum(F.xxhash64("id", "l").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
        scratch.remove(last)
        if now == before:
            scratch.remove(both)
            return label.select("id", F.col("l").alias("component"))
        before = now


def _classify(docs: DataFrame, opt: NearOptions, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch()
    sig = scratch.write(signatures(docs, opt, id_col, text))
    # a class is a set of shingles; it has a number of its own, as ids may be null or stand for several texts
    found = sig.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one"), F.min("sig").alias("sig"), F.min("planes").alias("planes"), F.min("n_shingles").alias("n"))
    classes = scratch.write(found.select("digest", F.monotonically_increasing_id().alias("cls"), F.col("one.doc_id").alias("rep_id"), F.col("one.text_hash").alias("rep_hash"), "sig", "planes", "n"))
    keys = chunk_keys(classes, opt)
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = scratch.write(keys.join(shared, "key", "leftsemi"))
    wanted = classes.join(members.select("cls").distinct(), "cls", "leftsemi").select("cls", "rep_id", "rep_hash")
    source = docs.select(F.col(id_col).alias("_i"), F.xxhash64(text).alias("_h"), F.col(text).alias("t"))
    texts = source.join(wanted, F.col("_i").eqNullSafe(F.col("rep_id")) & (F.col("_h") == F.col("rep_hash"))).select("cls", "t")
    texts = scratch.write(texts.dropDuplicates(["cls"]))
    about = classes.select("cls", "n", "planes").join(texts.select("cls"), "cls", "leftsemi").join(lone_shingles(texts, opt), "cls", "left")
    about = scratch.write(about.withColumn("u", F.coalesce("u", F.lit(0).cast("long"))).where(100 * (F.col("n") - F.col("u")) >= opt.percent * F.col("n")))
    # a set that is more than 100 / percent times as large as another is no link of it: by size, in steps of that ratio,
    # a link lies in one step or in two that adjoin
    step = F.floor(F.log("n") / math.log(100.0001 / opt.percent)).cast("int")
    m = members.join(about, "cls").withColumn("step", F.explode(F.array(step, step + 1)))
    m = m.select("key", "step", "cls", F.struct("n", "u", "planes").alias("x"))
    # the smallest class of a key and step, by partial aggregation: a key that a third of all classes share is a row a task
    rep = m.groupBy("key", "step").agg(F.min("cls").alias("rep"))
    star = m.join(rep, ["key", "step"]).where("cls <> rep").select("cls", "rep", "x").dropDuplicates(["cls", "rep"])
    star = star.join(about.select(F.col("cls").alias("rep"), F.struct("n", "u", "planes").alias("y")), "rep")
    star = star.where(_near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), opt))
    star = scratch.write(star.select(F.col("cls").alias("a"), F.col("rep").alias("b")))
    links = scratch.write(confirmed(star, texts, opt))
    comp = components(links, scratch)
    # members of different components under one key and size step
    m = m.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls")).drop("component", "x")
    mixed = m.groupBy("key", "step").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "step")
    m = scratch.write(m.join(mixed, ["key", "step"], "leftsemi"))
    links = scratch.write(links.union(_across(m, about, texts, opt, scratch)))
    comp = components(links, scratch)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    named = classes.select("digest", "cls", "rep_id", "rep_hash").join(comp.withColumnRenamed("id", "cls"), "cls", "left").join(degree, "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "rep_hash", "digest")).alias("first"))
    named = named.join(first, "component").select("digest", "component", F.col("first.rep_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                                                  (F.col("digest") == F.col("first.digest")).alias("chosen"), "rep_id", "rep_hash")
    named = scratch.write(named)
    scratch.remove_but(sig, named)
    return sig.select("doc_id", "text_hash", "n_shingles", "digest"), named


def _classified(docs: DataFrame, opt: NearOptions, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): for each row of ``docs`` (doc_id, text_hash, n_shingles, digest), and for each set of shingles (digest,
    component, its smallest id ``component_id``, ``n_links``, whether the component's chosen row is one of this class, and
    the id and text hash of that row). Both are written."""
    with batches_of(docs.sparkSession, BATCH):
        return _classify(docs, opt, id_col, text)


def near_components(docs: DataFrame, opt: NearOptions = NearOptions(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links, kept), one for each row of ``docs``.

    n_links counts the confirmed links found for the document's class (a spanning part of all links). component_id is the smallest
    id of the component (null if none has one); a row is kept if its id is that."""
    sig, named = _classified(docs, opt, id_col, text)
    out = sig.join(named.select("digest", "component_id", "n_links"), "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, opt: NearOptions = NearOptions(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component, with all their columns: the text with the smallest id (without any id,
    of the first class by digest), one of equal rows. Rows that share an id but are unlike stay; so do all rows without words."""
    _, named = _classified(docs, opt, id_col, text)
    keep = named.where("chosen").select("rep_id", "rep_hash").distinct()
    rows = docs.withColumn("_hash_of_text", F.xxhash64(text))
    on = F.col(id_col).eqNullSafe(F.col("rep_id")) & (F.col("_hash_of_text") == F.col("rep_hash"))
    some = rows.join(keep, on, "leftsemi").dropDuplicates([id_col, "_hash_of_text"]).drop("_hash_of_text")
    return some.unionByName(docs.where(F.size(words(F.col(text))) == 0))


def op6_hamming_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_components(docs, NearOptions(shingle=3, percent=85)).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_hamming_join": op6_hamming_join}
ORACLE: dict[str, str] = {}
