"""Ordered samples: the first ``n`` non-missing values of each column in ``order_by`` order.

``ORDER BY key LIMIT m`` keeps a heap of m rows in each task and merges the heaps (Spark's top-k), for any key: numbers, texts,
composite ones. The first m rows hold the first n values of every column without many gaps. Columns that don't have enough
yet go on among the rows that hold a value of any of them: ``n`` rows for each such column, so at least one of them is complete
after a round, and all are when the rows run out. No row of the table is expanded or sorted outside of the heaps; only the
rows that survive are turned into (column, value) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FRACTIONAL_TYPES, col, field_type, is_missing, py_float_text

FIRST_ROWS = 64         # heap of the first round, in rows, at least; few enough for wide rows
COLUMNS_A_ROUND = 100   # gappy columns that one later round looks at


def _order_cols(order_by) -> list[str]:
    if order_by is None:
        raise ValueError("this step depends on row order: pass order_by (a unique key column or list of columns)")
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _has(df: DataFrame, c: str):
    return ~is_missing(col(c), field_type(df, c))


def _held(top: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of ``top`` and, for each column, the values in them."""
    r = top.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(_has(top, c), 1)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return r["rows"], {c: r[f"n{i}"] for i, c in enumerate(columns)}


def prefixes(df: DataFrame, columns: list[str], order_by, n: int, counts: dict[str, int] | None = None, rows: int | None = None):
    """Pairs (columns, the first rows in order that hold the first ``n`` values of each of them). ``counts`` and ``rows`` are the
    non-missing counts and the row count where the caller has them; with few gaps they spare the job that counts what the first
    rows hold."""
    keys = [col(k).asc_nulls_first() for k in _order_cols(order_by)]
    want = {c: n if counts is None else min(n, counts[c]) for c in columns}
    open_ = [c for c in columns if want[c]]
    if not open_:
        return []
    first = max(FIRST_ROWS, 2 * n)
    top = df.orderBy(*keys).limit(first)
    if counts is not None and rows is not None and all(rows - counts[c] + want[c] <= first for c in open_):
        return [(open_, top)]
    read, held = _held(top, open_)
    done = [c for c in open_ if held[c] >= want[c] or read < first]
    out = [(done, top)] if done else []
    open_ = [c for c in open_ if c not in done]
    while open_:
        part = open_[:COLUMNS_A_ROUND]
        limit = n * len(part)
        any_ = reduce(lambda p, q: p | q, [_has(df, c) for c in part])
        top = df.where(any_).orderBy(*keys).limit(limit)
        read, held = _held(top, part)
        done = [c for c in part if held[c] >= want[c] or read < limit]
        out.append((done, top))
        open_ = [c for c in open_ if c not in done]
    return out


def _carried_text(c, dt: T.DataType):
    """A cheap text form that survives the limit and is turned into the reference's text afterwards."""
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, FRACTIONAL_TYPES):
        return c.cast("double").cast("string")   # exact round trip through text
    return c.cast("string")


def _final_text(v, dt: T.DataType):
    if isinstance(dt, FRACTIONAL_TYPES):
        return py_float_text(v.cast("double"))
    if isinstance(dt, T.BooleanType):
        return F.when(v == "true", F.lit("True")).when(v == "false", F.lit("False"))
    return v


def first_values(df: DataFrame, columns: list[str], order_by, n: int, *, counts: dict[str, int] | None = None,
                 rows: int | None = None) -> DataFrame:
    """Long frame ``(column, pos, value)`` with up to ``n`` rows per column, ``pos`` from 1.

    Missing cells (null, NaN) are skipped, as ``dropna()`` does. ``value`` is the cell as the text
    ``str(value)`` gives. The costly text form of numbers is built only for the values that are kept.
    ``counts`` and ``rows``: see ``prefixes``.
    """
    keys = _order_cols(order_by)
    types = [field_type(df, c) for c in columns]
    tmp_keys = [f"__k{i}" for i in range(len(keys))]
    parts = []
    for held, top in prefixes(df, columns, order_by, n, counts, rows) if columns else []:
        slots = [i for i, c in enumerate(columns) if c in set(held)]
        cells = [F.when(_has(df, columns[i]), _carried_text(col(columns[i]), types[i])).alias(str(i)) for i in slots]
        long = top.select(*[col(k).alias(t) for k, t in zip(keys, tmp_keys)], *cells)
        long = long.unpivot(tmp_keys, [str(i) for i in slots], "__slot", "value").where(F.col("value").isNotNull())
        w = Window.partitionBy("__slot").orderBy(*[F.col(t).asc_nulls_first() for t in tmp_keys])
        parts.append(long.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("__slot", "pos", "value"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, pos bigint, value string")
    few = reduce(DataFrame.unionByName, parts)
    # back to real names (which may hold dots or spaces) and to the reference's text
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(str(i)), F.lit(c))])
    text = F.col("value")
    for kind, dt in ((FRACTIONAL_TYPES, T.DoubleType()), (T.BooleanType, T.BooleanType())):    # one case for each kind
        slots = [str(i) for i, t in enumerate(types) if isinstance(t, kind)]
        if slots:
            text = F.when(F.col("__slot").isin(slots), _final_text(F.col("value"), dt)).otherwise(text)
    return few.select(F.element_at(names, F.col("__slot")).alias("column"), F.col("pos").cast("bigint").alias("pos"),
                      text.alias("value"))
