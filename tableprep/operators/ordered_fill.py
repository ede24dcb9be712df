"""Forward and backward fill in row order (M6, M7) without a single-partition window.

A window over the whole table puts every row into one task. Instead (two phases):

1. Splitters, quantiles of a sample of whole keys, cut the table into buckets in key order (``splitters``), whatever the
   key: numbers, times, texts with a long common beginning, composite keys with constant or hot first parts. They belong to the
   table that is filled and are found anew for each.
2. Per ``(partition keys, bucket)`` the last (first) non-missing value and its key, via
   ``max_by``/``min_by`` (partially aggregated: one row per task and bucket).
3. Carry across buckets on that small frame with a window ordered by bucket.
4. Within each bucket a normal window; a missing cell takes the in-bucket value, else the carry.

Both directions use running frames: a frame that ends with the partition is computed anew for each of its rows, which is the square
of a bucket's rows. A backward fill numbers the rows of a bucket in key order and runs over the numbers from the last to the first.

Without partition keys the carry frame has a row per bucket, with them one per (key, bucket); it is joined on the keys the
window shuffles on, so the big side is shuffled once. A hot partition key is split over all buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, field_type, is_missing
from .splitters import range_number, splitters


def _keys(order_by) -> list[str]:
    if order_by is None:
        raise ValueError("ordered fill needs order_by: a unique key")
    return [order_by] if isinstance(order_by, str) else list(order_by)


def default_buckets(df: DataFrame) -> int:
    """One bucket per shuffle partition: the cluster sizes that setting to the data."""
    spark = df.sparkSession
    try:
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:  # e.g. "auto" on some platforms
        shuffle = 200
    return max(2, shuffle)


def boundaries(df: DataFrame, order_by, buckets: int, rows: int | None = None) -> list[tuple]:
    """Keys that cut ``df`` into about ``buckets`` even parts in the order of the whole key."""
    return splitters(df, _keys(order_by), buckets, rows)


def with_bucket(df: DataFrame, order_by, bounds: list[tuple], out: str) -> DataFrame:
    """``df`` with its bucket: the number of boundaries that are at most the row's key."""
    return range_number(df, _keys(order_by), bounds, out)


def ordered_fill(
    df: DataFrame,
    columns: list[str],
    order_by,
    direction: str = "forward",
    partition_by: list[str] | None = None,
    buckets: int | None = None,
    bounds: list[tuple] | None = None,
) -> DataFrame:
    """Fill missing cells of ``columns`` from the previous (forward) or next (backward) non-missing
    value in ``order_by`` order, within ``partition_by`` groups if given. Leading (trailing) gaps stay.

    ``bounds`` are bucket boundaries found earlier (any sorted list gives the same result; good ones
    balance the buckets). Without them they are found now."""
    if not columns:
        return df
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be forward or backward")
    keys = _keys(order_by)
    parts = list(partition_by or [])
    fwd = direction == "forward"
    if bounds is None:
        bounds = boundaries(df, keys, buckets or default_buckets(df))
    b = "__bucket"
    x = with_bucket(df, keys, bounds, b)
    # a single key orders max_by/min_by directly (fixed width: hash aggregation for numeric values)
    order_struct = col(keys[0]) if len(keys) == 1 else F.struct(*[col(k) for k in keys])
    vals = {c: F.when(~is_missing(col(c), field_type(df, c)), col(c)) for c in columns}

    # phase 2: edge value per (partition keys, bucket)
    pick = F.max_by if fwd else F.min_by
    def edge(v):
        by_key = pick(v, F.when(v.isNotNull(), order_struct))
        if len(keys) > 1:
            return by_key
        null_key = F.max(F.when(col(keys[0]).isNull(), v))     # max_by passes null keys over; the one of a unique key comes first
        return F.coalesce(by_key, null_key) if fwd else F.coalesce(null_key, by_key)

    edge_aggs = [edge(vals[c]).alias(f"__e{i}") for i, c in enumerate(columns)]
    group_cols = [col(p) for p in parts] + [F.col(b)]
    edges = x.groupBy(*group_cols).agg(*edge_aggs)

    # phase 3: carry across buckets (small frame)
    w_carry = Window.partitionBy(*[col(p) for p in parts]).orderBy(F.col(b).asc() if fwd else F.col(b).desc())
    w_carry = w_carry.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(*[col(p) for p in parts], F.col(b),
                         *[F.last(f"__e{i}", ignorenulls=True).over(w_carry).alias(f"__c{i}") for i in range(len(columns))])
    join_keys = parts + [b]
    # null partition keys are a group of their own
    x = x.join(carry.toDF(*[f"__j{i}" if i < len(join_keys) else c for i, c in enumerate(carry.columns)]),
               reduce(lambda p, q: p & q, [F.col(f"`{k}`").eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(join_keys)]), "left")

    # phase 4: within-bucket window, then the carry
    bucket = Window.partitionBy(*[col(p) for p in parts], F.col(b))
    w_in = bucket.orderBy(*[col(k).asc_nulls_first() for k in keys])
    if not fwd:     # rows with equal keys keep their order, too
        x = x.withColumn("__place", F.row_number().over(w_in))
        w_in = bucket.orderBy(F.col("__place").desc())
    w_in = w_in.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for f in df.schema.fields:
        if f.name in columns:
            i = columns.index(f.name)
            inside = F.last(vals[f.name], ignorenulls=True).over(w_in)
            filled = F.when(~is_missing(col(f.name), f.dataType), col(f.name)).otherwise(
                F.coalesce(inside, F.col(f"__c{i}")))
            out.append(filled.cast(f.dataType).alias(f.name))
        else:
            out.append(col(f.name))
    return x.select(*out)
