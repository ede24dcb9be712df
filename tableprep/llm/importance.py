"""Operator 13 - target-distribution importance resampling with deduplicated segments.

Every document gets the log ratio of a target's and the corpus's bucketed n-gram distributions as its weight, Gumbel noise
drawn from its id makes a score of it, and the highest scores are drawn (a sample without replacement by importance).

**Counting.** Newlines are separators, so a text's words are those of its lines, and its n-grams are those within the lines
plus the few that cross a line end. Spark groups the lines of all texts; the features of a distinct line are made once
and counted as often as the line occurs. The n-grams that cross line ends are counted apart, from the outer words of each
line only. What leaves a task is one number for each bucket. Counts are exact; no line is left out, and a line that a third of
all texts share is one row a task after partial aggregation.

**Features** are never built as strings: the checksum of "a b" follows from those of "a" and " b" by a linear map over GF(2)
that depends on the length of " b" alone, so bucket numbers are table look-ups over arrays of word numbers.

**Drawing.** Scores are cut into ranges at their quantiles, denser above the share to be drawn; ranks are offsets of ranges plus row
numbers within a range. Equal rows are counted before that, so no range is filled by copies of one row.

Defined results: null or empty text has no features and weight 0; a null id is hashed as the text ``null`` and comes first
among ties; of further ties that with the smaller weight, features and words; equal rows get a rank each; an empty target or
corpus has zero counts; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import table

LINE_END = 10
TABLE_LENGTHS = 64      # lengths with a look-up table; n-grams of longer words are hashed byte by byte
KNOWN_WORDS = 1 << 20   # words whose checksums a task keeps, then begins anew
PORTION = 8 << 20       # bytes of text that one step works on


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 3            # words of a feature; 1 to 3
    percent: int = 5            # of the documents with at least min_words
    min_words: int = 20
    seed: int = 42


def _letters() -> bytes:
    """A byte table: A-Z lower-cased, digits, letters and all bytes above 127 kept, line ends kept, the rest made spaces."""
    keep = {*range(48, 58), *range(97, 123), *range(128, 256), LINE_END}
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


LETTERS = _letters()


def _shift_tables() -> np.ndarray:
    """``[length, k, byte]``: what a checksum becomes when ``length`` bytes follow it, by its k-th byte."""
    one = np.zeros((4, 256), np.uint32)
    for b in range(256):        # one byte more, as a map of the whole register; zero bytes taken out again
        for k in range(4):
            one[k, b] = zlib.crc32(b"\0", b << (8 * k)) ^ zlib.crc32(b"\0")
    out = np.zeros((TABLE_LENGTHS + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, TABLE_LENGTHS + 1):
        before = out[n - 1]
        out[n] = one[0][before & 255] ^ one[1][before >> 8 & 255] ^ one[2][before >> 16 & 255] ^ one[3][before >> 24]
    return out


class Buckets:
    """Bucket numbers of the features of word sequences."""

    def __init__(self, spec: Resampling):
        self.spec = spec
        self.tables = _shift_tables().reshape(-1)
        self._begin()

    def _begin(self):
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.sums = np.zeros((3, 1024), np.int64)       # checksum of the word, of a space and the word, length of the latter

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > KNOWN_WORDS:
            self._begin()
        new = [w for w in set(words) if w not in self.number]
        at = len(self.words)
        if at + len(new) > self.sums.shape[1]:
            self.sums = np.pad(self.sums, ((0, 0), (0, at + len(new))))
        for i, w in enumerate(new, at):
            self.number[w] = i
            self.sums[:, i] = zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1
        self.words += new
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _followed(self, sums, ids):
        """Checksums of features, each followed by a space and a word."""
        _, spaced, length = self.sums[:, ids]
        base = np.minimum(length, TABLE_LENGTHS) * 1024
        t = self.tables
        moved = t[base + (sums & 255)] ^ t[base + 256 + (sums >> 8 & 255)] ^ t[base + 512 + (sums >> 16 & 255)] ^ t[base + 768 + (sums >> 24)]
        out = moved.astype(np.int64) ^ spaced
        for i in np.flatnonzero(length > TABLE_LENGTHS):
            out[i] = zlib.crc32(b" " + self.words[ids[i]], int(sums[i]))
        return out

    def features(self, ids: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        """Buckets of the features of ``n`` words that begin at the given places of ``ids``."""
        sums = self.sums[0][ids[starts]]
        for k in range(1, n):
            sums = self._followed(sums, ids[starts + k])
        return sums % self.spec.buckets


def _portions(batches):
    """Texts with the value beside each, in portions of about ``PORTION`` bytes."""
    texts, beside, size = [], [], 0
    for b in batches:
        for x, y in zip(b.column(0), b.column(1)):
            raw = x.as_py() or b""
            texts.append(raw)
            beside.append(y.as_py())
            size += len(raw)
            if size >= PORTION:
                yield texts, beside
                texts, beside, size = [], [], 0
    if texts:
        yield texts, beside


def _joined(texts: list[bytes], outer: bool):
    """Words of all texts one after another, the text of each, and the line of each (lines of no words have none). With
    ``outer`` only the two outer words at both ends of a line."""
    words, lengths, line_of = [], [], []
    for raw in texts:
        before = len(words)
        for line in raw.translate(LETTERS).split(b"\n") if outer else [raw.translate(LETTERS).replace(b"\n", b" ")]:
            w = line.split()
            if outer and len(w) > 4:
                w = w[:2] + w[-2:]
            words += w
            if outer:
                line_of.append(len(w))
        lengths.append(len(words) - before)
    text = np.repeat(np.arange(len(texts)), lengths)
    line = np.repeat(np.arange(len(line_of)), line_of) if outer else text
    return words, text, line


def _emitted(total: np.ndarray):
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def _within(n: int, same: np.ndarray) -> np.ndarray:
    """Places from which ``n`` words belong to one group."""
    if len(same) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(same[: len(same) - n + 1] == same[n - 1:])


def _count_lines(spec: Resampling):
    def run(batches):
        hashed, total = Buckets(spec), np.zeros(spec.buckets, np.int64)
        for lines, times in _portions(batches):
            words, text, _ = _joined(lines, False)
            ids, times = hashed.numbers(words), np.array(times, np.int64)
            for n in range(1, spec.longest + 1):
                at = _within(n, text)
                np.add.at(total, hashed.features(ids, n, at), times[text[at]])
        yield from _emitted(total)
    return run


def _count_across(spec: Resampling):
    def run(batches):
        hashed, total = Buckets(spec), np.zeros(spec.buckets, np.int64)
        for texts, times in _portions(batches):
            words, text, line = _joined(texts, True)
            ids, times = hashed.numbers(words), np.array(times, np.int64)
            for n in range(2, spec.longest + 1):
                at = _within(n, text)
                at = at[line[at] != line[at + n - 1]]
                np.add.at(total, hashed.features(ids, n, at), times[text[at]])
        yield from _emitted(total)
    return run


def bucket_counts(texts: DataFrame, spec: Resampling = Resampling(), text: str = "text") -> DataFrame:
    """Rows (bucket, n): features of all texts, counted by distinct lines and across line ends."""
    raw = texts.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    lines = raw.select(F.explode(F.split("t", "\n")).alias("t")).where(F.col("t") != "").groupBy("t").agg(F.count("*").alias("times"))
    lines = lines.select(F.col("t").cast("binary"), "times").mapInArrow(_count_lines(spec), "bucket int, n long")
    cut = raw.where(F.contains("t", F.lit("\n"))).select(F.col("t").cast("binary"), F.lit(1).cast("long").alias("times"))
    across = cut.mapInArrow(_count_across(spec), "bucket int, n long")
    return lines.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, spec: Resampling = Resampling()) -> np.ndarray:
    """The gain of each bucket, in thousandths: as many numbers as there are buckets, whatever the corpus."""
    s, t = np.zeros(spec.buckets), np.zeros(spec.buckets)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    up, down = (t + 1) * (s.sum() + spec.buckets), (s + 1) * (t.sum() + spec.buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(up.tolist(), down.tolist())], np.int64)


def _weighed(spec: Resampling, gain: np.ndarray):
    def run(batches):
        hashed = Buckets(spec)
        for texts, ids_out in _portions(batches):
            words, text, _ = _joined(texts, False)
            ids, sums = hashed.numbers(words), np.zeros(len(texts), np.int64)
            for n in range(1, spec.longest + 1):
                at = _within(n, text)
                np.add.at(sums, text[at], gain[hashed.features(ids, n, at)])
            n_words = np.bincount(text, minlength=len(texts)).astype(np.int64)
            n_features = sum(np.maximum(n_words - k, 0) for k in range(spec.longest))
            cols = [pa.array(ids_out, pa.int64()), pa.array(n_words), pa.array(n_features), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight"])
    return run


def weights(docs: DataFrame, gain: np.ndarray, spec: Resampling = Resampling(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score), one for each row of ``docs``; nothing is shuffled."""
    rows = docs.select(F.col(text).cast("string").cast("binary").alias("t"), F.col(id_col).cast("long").alias("doc_id"))
    out = rows.mapInArrow(_weighed(spec, gain), "doc_id long, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise)


ROW = ["doc_id", "n_words", "n_features", "weight", "score"]


def drawn(scored: DataFrame, spec: Resampling = Resampling()) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by falling score for the share that is drawn, null for the others."""
    spark = scored.sparkSession
    open_ = F.col("n_words") >= spec.min_words
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    share = spec.percent / 100
    steps = [1 - share * 1.02 * i / parts for i in range(1, parts + 1)]
    steps += [1 - share * 1.02 - (1 - share * 1.02) * i / 20 for i in range(1, 20)] if share * 1.02 < 1 else []
    steps = [p for p in steps if 0 < p < 1]
    fine = min(1_000_000, max(10_000, int(20 * parts / max(share, 0.01))))
    r = scored.where(open_).agg(F.count("*").alias("n"), F.percentile_approx("score", steps or [0.5], fine).alias("q")).first()
    n_drawn = spec.percent * r["n"] // 100
    bounds = sorted(set(r["q"] or []), reverse=True)
    range_no = F.lit(0)
    if bounds:      # the number of bounds above the score, by a search over the sorted bounds
        from pyspark.ml.feature import Bucketizer

        cut = Bucketizer(splits=[-math.inf, *map(float, reversed(bounds)), math.inf], inputCol="_x", outputCol="_b")
        scored = cut.transform(scored.withColumn("_x", F.col("score").cast("double"))).drop("_x")
        range_no = len(bounds) - F.col("_b").cast("int")
    same = scored.groupBy(*ROW, range_no.alias("range_no"), open_.alias("open")).agg(F.count("*").alias("times"))
    sizes = {x["range_no"]: x["n"] for x in scored.where(open_).groupBy(range_no.alias("range_no")).agg(F.count("*").alias("n")).collect()}
    offset, offsets = 0, []
    for k in sorted(sizes):
        if offset < n_drawn:
            offsets += [F.lit(k), F.lit(offset)]
        offset += sizes[k]
    if not offsets:
        return same.select(*ROW, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*ROW, F.lit(None).cast("long").alias("rank"))
    before = F.try_element_at(F.create_map(*offsets), F.col("range_no")).cast("long")
    high = F.col("open") & before.isNotNull()
    by = Window.partitionBy("range_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "weight", "n_features", "n_words")
    by = by.rowsBetween(Window.unboundedPreceding, -1)
    top = same.where(high).withColumn("at", before + F.coalesce(F.sum("times").over(by), F.lit(0)))
    top = top.select(*ROW, "at", F.posexplode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i", "x"))
    rank = F.col("at") + F.col("i") + 1
    top = top.select(*ROW, F.when(rank <= n_drawn, rank).cast("long").alias("rank"))
    rest = same.where(~F.coalesce(high, F.lit(False))).select(*ROW, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return top.unionByName(rest.select(*ROW, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, spec: Resampling = Resampling(), id_col: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its weight, score and rank; rows with a rank are the resampled corpus."""
    gain = gains(bucket_counts(docs, spec, text), bucket_counts(target, spec, target_text), spec)
    scored, _ = write_and_read(weights(docs, gain, spec, id_col, text))
    return drawn(scored, spec)


def op13_importance_resampling(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLE: dict[str, str] = {}
