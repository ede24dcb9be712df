"""Exact medians without gathering a column in one task (M4): radix selection.

Spark's exact ``median`` keeps every distinct value of a group in one aggregation buffer; for a whole-table median that is one
task holding the column. Here a double is seen as a 64-bit integer that orders as the double does, and the two middle ranks
are found digit by digit, 16 bits a round: of all values that begin with the digits found so far, the next digits are
counted (partial aggregation: at most 65,536 rows for each column, rank and task), and the digit in which the rank falls is
picked on the cluster. All columns share each round's job, so the whole table takes a count job (with the least and largest value,
whose common bits are known) and at most four rounds, whatever the values: heavy values, long tails, subnormal numbers and infinities
alike. A rank whose values are all equal is done early.

Interpolates between the two middle values like pandas and DuckDB.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16      # bits of a round
LEAST_EXPONENT, LARGEST_EXPONENT = -1022, 1023


def _exponent(x: Column, about: Column) -> Column:
    """The exponent of a positive double, from ``about``, the floor of its logarithm, which may be off by one."""
    e = F.when(F.pow(F.lit(2.0), F.greatest(about, F.lit(LEAST_EXPONENT)).cast("double")) > x, about - 1).when(
        F.pow(F.lit(2.0), F.least(about + 1, F.lit(LARGEST_EXPONENT)).cast("double")) <= x, about + 1).otherwise(about)
    return F.least(F.greatest(e, F.lit(LEAST_EXPONENT)), F.lit(LARGEST_EXPONENT))


def _bits(d: Column, e: Column) -> Column:
    x = F.abs(d)
    # the significand as an integer below 2^53: in two steps, as 2^-e alone may not be a double
    whole = ((x * F.pow(F.lit(2.0), (-F.floor(e / 2)).cast("double"))) * F.pow(F.lit(2.0), (52 - (e - F.floor(e / 2))).cast("double"))).cast("long")
    normal = (e - LEAST_EXPONENT).cast("long") * F.lit(1 << 52) + whole
    bits = F.when(x == 0, F.lit(0).cast("long")).when(x == float("inf"), F.lit(0x7FF << 52)).otherwise(normal)
    return F.when(d.isNotNull() & ~F.isnan(d), F.when(d < 0, -bits).otherwise(bits))


def ordered_bits(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For each named double its bits as a long that orders as the doubles do; -0.0 and 0.0 are equal. Null and NaN give null.

    Built from arithmetic that is exact in doubles: scalings by powers of two. Each step is a projection of its own, so
    that a logarithm is taken once for a value."""
    x = df.select(*[v.alias(c) for c, v in values.items()])
    x = x.select("*", *[F.floor(F.least(F.log2(F.abs(F.col(c))), F.lit(2000.0))).alias(f"{c}_about") for c in values])
    x = x.select(*values, *[_exponent(F.abs(F.col(c)), F.col(f"{c}_about")).alias(f"{c}_e") for c in values])
    return x.select(*[_bits(F.col(c), F.col(f"{c}_e")).alias(c) for c in values])


def value_of(bits: int) -> float:
    """The double of ``ordered_bits``."""
    x = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -x if bits < 0 else x


def exact_medians(df: DataFrame, specs: dict, columns_a_job: int = 100) -> dict:
    """Exact medians of many columns: ``specs`` maps a name to ``(value, condition)``, the value column (cast to double) and
    an optional row condition. None where no value is left. ``columns_a_job`` bounds the width of one plan."""
    names = list(specs)
    out: dict = {}
    for k in range(0, len(names), columns_a_job):
        out |= _medians(df, {c: specs[c] for c in names[k:k + columns_a_job]})
    return out


def _medians(df: DataFrame, specs: dict) -> dict:
    names = list(specs)
    values = {}
    for i, c in enumerate(names):
        v, cond = specs[c]
        v = v.cast("double")
        values[f"v{i}"] = v if cond is None else F.when(cond, v)
    images = ordered_bits(df, values)
    counts = images.agg(*[e for i in range(len(names)) for e in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"))]).first()
    out = {c: None for i, c in enumerate(names) if not counts[f"n{i}"]}
    # a target: column number, which of the two middle ranks; its bits so far and its rank among the values that begin with them.
    # The bits that a column's least and largest value share are known, so a round begins behind them.
    targets, ends, left = {}, {}, {}
    for i, c in enumerate(names):
        n = counts[f"n{i}"]
        if not n:
            continue
        lo, hi = counts[f"lo{i}"], counts[f"hi{i}"]
        left[i] = 64 if (lo < 0) != (hi < 0) else (lo ^ hi).bit_length()
        for side, rank in ((0, (n - 1) // 2), (1, n // 2)):
            if side == 0 or n % 2 == 0:
                if lo == hi:
                    ends[(i, side)] = value_of(lo)
                else:
                    targets[(i, side)] = (lo >> left[i], rank)
    while targets:
        found = _round(images, targets, left)
        left = {i: max(0, b - DIGIT) for i, b in left.items()}
        for t, (digits, rank, least, largest) in found.items():
            if least == largest or not left[t[0]]:
                ends[t] = value_of(least)
                del targets[t]
            else:
                targets[t] = (digits, rank)
    for i, c in enumerate(names):
        if (i, 0) in ends:
            a = ends[(i, 0)]
            b = ends.get((i, 1), a)
            out[c] = a if a == b else (a + b) / 2.0
    return out


def _round(images: DataFrame, targets: dict, left: dict[int, int]) -> dict:
    """For each target the bits found now, its rank among them, and the least and the largest image with these bits. ``left``:
    how many bits of each column's images aren't known yet."""
    live = sorted({i for i, _ in targets})
    by_column = lambda f: F.create_map(*[e for i in live for e in (F.lit(i), f(i))])[F.col("c")]
    begins = by_column(lambda i: F.array(*[F.lit(targets[t][0]).cast("long") for t in sorted(targets) if t[0] == i]))
    known = by_column(lambda i: F.lit(left[i]))
    shift = by_column(lambda i: F.lit(max(0, left[i] - DIGIT)))
    right = lambda x, n: F.call_function("shiftright", x, n)
    rows = images.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("x")) for i in live])).alias("r")).select("r.*")
    rows = rows.where(F.col("x").isNotNull() & ((known == 64) | F.array_contains(begins, right(F.col("x"), known))))
    counts = rows.groupBy("c", right(F.col("x"), shift).alias("digits")).agg(
        F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("largest"))
    want = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(side).alias("side"), F.lit(begin).cast("long").alias("begin"), F.lit(rank).cast("long").alias("rank"))
                     for (i, side), (begin, rank) in sorted(targets.items())])
    counts = counts.withColumn("k", known).withColumn("t", F.explode(F.filter(want, lambda t: (t["c"] == F.col("c")) & (
        (F.col("k") == 64) | (t["begin"] == right(F.col("least"), F.col("k")))))))
    # at most 2^DIGIT rows for each target
    by = Window.partitionBy("c", "t.side").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("n").over(by), F.lit(0)))
    hit = counts.where((F.col("below") <= F.col("t.rank")) & (F.col("t.rank") < F.col("below") + F.col("n")))
    return {(r["c"], r["t"]["side"]): (r["digits"], r["t"]["rank"] - r["below"], r["least"], r["largest"]) for r in hit.collect()}
