"""Ranges of a table in the order of any key, also a composite one.

``splitters`` draws a random sample of whole keys (a struct of the key columns, so a constant or hot first column costs nothing),
sorts it and takes even quantiles. ``range_number`` finds a row's range by binary search over the splitters as an array of
structs: one comparison of structs for each halving, each a projection of its own, all in generated code. Structs compare
field by field with nulls first, as ``ORDER BY`` does, whatever the types: numbers, times, texts, decimals, booleans.

Any list of splitters gives ranges in key order; a good one makes them even. With ``SAMPLED`` keys a range the spread of a range's
size is about ``1 / sqrt(SAMPLED)`` of it. Rows with equal keys are in one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, field_type, typed_lit

SAMPLED = 64            # sampled keys for each range


def _key(keys: list[str]) -> F.Column:
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def check_order_key(df: DataFrame, keys: list[str]) -> None:
    for k in keys:
        dt = field_type(df, k)
        if isinstance(dt, (T.MapType, T.ArrayType, T.StructType, T.VariantType, T.CalendarIntervalType)):
            raise ValueError(f"order key {k!r} can't be ordered: {dt.simpleString()}")


def splitters(df: DataFrame, keys: list[str], ranges: int, rows: int | None = None, seed: int = 17) -> list[tuple]:
    """At most ``ranges - 1`` keys that cut ``df`` into even ranges: a count (unless ``rows`` is known) and one job over the
    key columns alone, of which ``SAMPLED * ranges`` keys or so reach the driver."""
    check_order_key(df, keys)
    if ranges <= 1:
        return []
    only = df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = only.count() if rows is None else rows
    share = SAMPLED * ranges / max(rows, 1)
    drawn = only if share >= 1 else only.sample(fraction=share, seed=seed)
    found = [tuple(r) for r in drawn.orderBy(*[F.col(c).asc_nulls_first() for c in only.columns]).collect()]
    cuts = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def range_number(df: DataFrame, keys: list[str], cuts: list[tuple], out: str) -> DataFrame:
    """``df`` with the number of splitters that are at most the row's key."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    types = [field_type(df, k) for k in keys]
    steps = len(cuts).bit_length()
    made = [F.struct(*[typed_lit(v, dt).alias(f"k{i}") for i, (v, dt) in enumerate(zip(c, types))]) for c in cuts]
    bounds, key, at = F.array(*made), _key(keys), F.lit(0)
    own = df.columns
    x = df
    for s in range(steps - 1, -1, -1):      # a place beyond the last splitter is null and counts as too far
        at = at + F.when(F.get(bounds, at + ((1 << s) - 1)) <= key, 1 << s).otherwise(0)
        x = x.select(*[col(c) for c in own], at.alias(out))
        at = F.col(out)
    return x
