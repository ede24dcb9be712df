"""Structure and names (S1, S2, S6) and type inference and conversion.

Type evidence for every text column comes from the profile aggregate (one job) plus one
ordered sample of 10 values for the datetime test (one job). Decisions are made on the driver
over these few numbers; the conversion is one ``select``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    BOOLEAN_PAIRS,
    DATETIME_FORMATS,
    FRACTIONAL_TYPES,
    INTEGRAL_TYPES,
    TEMPORAL_TYPES,
    as_text,
    col,
    to_boolean,
    to_datetime,
    to_number,
)
from ..functions.naming import convert_names
from .profile import Profile, profile
from .sample import first_values

LOGICAL_TYPES = ("numeric", "datetime", "categorical", "text", "boolean")
DATETIME_SAMPLE = 10
CATEGORICAL_RATIO = 0.1   # fixed value: distinct / non-null below this
CATEGORICAL_MAX = 50      # fixed value: and fewer distinct values than this


# --- S1, S2, S6 -------------------------------------------------------------------------

def duplicate_columns(df: DataFrame) -> list[str]:
    """Names that occur more than once (exact)."""
    seen, dup = set(), []
    for c in df.columns:
        if c in seen and c not in dup:
            dup.append(c)
        seen.add(c)
    return dup


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of each name (by position; contents are not compared)."""
    names = df.columns
    keep = [i for i, c in enumerate(names) if c not in names[:i]]
    if len(keep) == len(names):
        return df
    tmp = [f"__c{i}" for i in range(len(names))]
    return df.toDF(*tmp).select(*[F.col(tmp[i]).alias(names[i]) for i in keep])


def drop_empty_columns(df: DataFrame, prof: Profile | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns without any non-missing value."""
    prof = prof or profile(df)
    empty = prof.empty_columns()
    return (df.drop(*empty) if empty else df), empty


def rename_columns(df: DataFrame, convention: str = "snake_case") -> tuple[DataFrame, dict[str, str]]:
    """Rename under a convention; returns the old -> new map of changed names. No job."""
    new = convert_names(df.columns, convention)
    mapping = {o: n for o, n in zip(df.columns, new) if o != n}
    return (df.toDF(*new) if mapping else df), mapping


# --- S7-S11 ------------------------------------------------------------------------------

@dataclass(frozen=True)
class TypeDecision:
    column: str
    detected: str                 # numeric, datetime, boolean, categorical, text
    physical: str                 # Spark type name now
    target: str | None = None     # Spark type after conversion, None = unchanged
    fmt: str | None = None        # datetime format for text
    evidence: str = ""


def _datetime_formats(df: DataFrame, columns: list[str], order_by, n: int = DATETIME_SAMPLE) -> dict[str, str]:
    """Per text column the first format that parses all of its first ``n`` values (one job)."""
    if not columns:
        return {}
    s = first_values(df, columns, order_by, n)
    aggs = [F.min(F.when(to_datetime(F.col("value"), f).isNotNull(), 1).otherwise(0)).alias(f"f{i}")
            for i, f in enumerate(DATETIME_FORMATS)]
    out = {}
    for r in s.groupBy("column").agg(*aggs).collect():
        for i, f in enumerate(DATETIME_FORMATS):
            if r[f"f{i}"] == 1:
                out[r["column"]] = f
                break
    return out


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q9 long form: (column, n_distinct), nulls and NaN not counted.

    Columns of one type are unpivoted together; ``groupBy(column, value)`` then ``groupBy(column)``
    are both partially aggregated, so a value held by a third of the rows costs one row per task.
    """
    from ..functions.columns import field_type, is_missing

    spark = df.sparkSession
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(field_type(df, c).simpleString(), []).append(c)
    parts = []
    for _, cols in groups.items():
        proj = [F.when(~is_missing(col(c), field_type(df, c)), col(c)).alias(f"__v{i}") for i, c in enumerate(cols)]
        names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"__v{i}"), F.lit(c))])
        long = (df.select(*proj).unpivot([], [f"__v{i}" for i in range(len(cols))], "__slot", "value")
                .where(F.col("value").isNotNull()))
        d = long.groupBy("__slot", "value").count().groupBy("__slot").count()
        parts.append(d.select(F.element_at(names, F.col("__slot")).alias("column"),
                              F.col("count").alias("n_distinct")))
    if not parts:
        return spark.createDataFrame([], "column string, n_distinct bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # columns without any value have no row: add them with 0
    all_cols = spark.createDataFrame([(c,) for c in columns], "column string")
    return all_cols.join(F.broadcast(out), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"))


SKETCH_BITS = 14        # log2 of a sketch's buckets: a standard error of 0.8 %, 8 KB a column


def distinct_sketch(df: DataFrame, name: str):
    """Q9 as a mergeable sketch of a column's values (HyperLogLog, a few KB), nulls and NaN not counted: one more
    aggregate of a pass that is made anyway, and sketches of several tables or runs can be united."""
    from ..functions.columns import field_type, is_missing

    dt = field_type(df, name)
    c = col(name)
    v = c.cast("long") if isinstance(dt, INTEGRAL_TYPES) else (c + F.lit(0.0)).cast("string") if isinstance(dt, FRACTIONAL_TYPES) else c.cast("string")
    return F.hll_sketch_agg(F.when(~is_missing(c, dt), v), F.lit(SKETCH_BITS))


def infer_types(
    df: DataFrame,
    order_by=None,
    prof: Profile | None = None,
    *,
    categorical: bool = True,
    datetime_formats: dict[str, str] | None = None,
) -> list[TypeDecision]:
    """S11 for every column. Text columns get tests in the order boolean, numeric, datetime, categorical.

    ``datetime_formats`` may carry formats already found on a shared sample (then no sample job runs here).
    """
    prof = prof or profile(df, text_evidence=True, distinct_floor=categorical)
    lacks = any(isinstance(dt, T.StringType) and "bad_number" not in prof.stats.get(c, {})
                for c, dt in prof.dtypes.items())
    if lacks:
        prof = profile(df, text_evidence=True, distinct_floor=categorical)
    decisions: dict[str, TypeDecision] = {}
    need_dt, need_cat = [], []
    for c in prof.columns:
        dt = prof.dtypes[c]
        st = prof.stats.get(c, {})
        nonnull = prof.non_missing(c)
        phys = dt.simpleString()
        if nonnull == 0:
            decisions[c] = TypeDecision(c, "text", phys, evidence="all missing")
        elif isinstance(dt, T.BooleanType):
            decisions[c] = TypeDecision(c, "boolean", phys, evidence="boolean type")
        elif isinstance(dt, INTEGRAL_TYPES):
            lo, hi = st.get("min"), st.get("max")
            if lo is not None and lo >= 0 and hi <= 1:
                decisions[c] = TypeDecision(c, "boolean", phys, evidence="values within {0, 1}")
            else:
                decisions[c] = TypeDecision(c, "numeric", phys, evidence="numeric type")
        elif isinstance(dt, FRACTIONAL_TYPES + (T.DecimalType,)):
            decisions[c] = TypeDecision(c, "numeric", phys, evidence="numeric type")
        elif isinstance(dt, TEMPORAL_TYPES):
            decisions[c] = TypeDecision(c, "datetime", phys, evidence="temporal type")
        elif isinstance(dt, T.StringType):
            pairs = [i for i in range(len(BOOLEAN_PAIRS)) if st.get(f"bool_{i}") == 1]
            if pairs:
                decisions[c] = TypeDecision(c, "boolean", phys, evidence="values within " + "/".join(BOOLEAN_PAIRS[pairs[0]]))
            elif st.get("bad_number", 1) == 0:
                target = "bigint" if st.get("not_long", 1) == 0 else "double"
                decisions[c] = TypeDecision(c, "numeric", phys, target=target, evidence="all values parse as numbers")
            else:
                need_dt.append(c)
        else:
            decisions[c] = TypeDecision(c, "text", phys, evidence="no handling for this type")
    if datetime_formats is not None:
        formats = {c: datetime_formats[c] for c in need_dt if c in datetime_formats}
    else:
        formats = _datetime_formats(df, need_dt, order_by) if need_dt else {}
    for c in need_dt:
        if c in formats:
            decisions[c] = TypeDecision(c, "datetime", "string", target="timestamp_ntz", fmt=formats[c],
                                        evidence=f"first {DATETIME_SAMPLE} values parse with {formats[c]}")
        else:
            need_cat.append(c)
    if need_cat and categorical:
        floor = {c: prof.stats[c].get("distinct_floor") or 0 for c in need_cat}
        # a column that has too many values at least is decided; the others' distinct values are few, and counted exactly
        check = [c for c in need_cat if floor[c] < CATEGORICAL_MAX and floor[c] < CATEGORICAL_RATIO * prof.non_missing(c)]
        exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, check).collect()} if check else {}
        for c in need_cat:
            nd = exact.get(c)
            nonnull = prof.non_missing(c)
            if nd is not None and nd / nonnull < CATEGORICAL_RATIO and nd < CATEGORICAL_MAX:
                decisions[c] = TypeDecision(c, "categorical", "string", evidence=f"{nd} distinct of {nonnull}")
            else:
                decisions[c] = TypeDecision(c, "text", "string", evidence="text")
    else:
        for c in need_cat:
            decisions[c] = TypeDecision(c, "text", "string", evidence="text")
    return [decisions[c] for c in prof.columns]


# --- S12-S20 -------------------------------------------------------------------------------

def cast_expr(df: DataFrame, name: str, logical: str, fmt: str | None = None, integral: bool | None = None,
              text_booleans: bool = True):
    """The column converted to a logical type; None when the conversion does not apply."""
    from ..functions.columns import field_type

    dt = field_type(df, name)
    c = col(name)
    is_text = isinstance(dt, T.StringType)
    if logical == "numeric":
        if is_text:
            return to_number(c, bool(integral))
        if isinstance(dt, T.BooleanType):
            return c.cast("int")
        if isinstance(dt, TEMPORAL_TYPES):
            return None
        return c
    if logical == "datetime":
        if is_text:
            return to_datetime(c, fmt or "yyyy-M-d")
        if isinstance(dt, TEMPORAL_TYPES):
            return c.cast("timestamp_ntz")
        return None
    if logical == "boolean":
        if is_text:
            return to_boolean(c) if text_booleans else None
        if isinstance(dt, INTEGRAL_TYPES):
            return F.when(c == 1, True).when(c == 0, False)
        if isinstance(dt, T.BooleanType):
            return c
        return None
    if logical == "categorical":
        return c.cast("string") if not is_text else c
    if logical == "text":
        return as_text(c, dt)
    raise ValueError(f"unknown logical type {logical!r}; use one of {LOGICAL_TYPES}")


CATEGORICAL_META = {"logical": "categorical"}


def convert_types(
    df: DataFrame,
    decisions: list[TypeDecision],
    *,
    text_booleans: bool = False,
) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Convert text columns detected as numeric, datetime (and boolean with ``text_booleans``).

    Returns the new frame and ``{column: (from, to)}`` for columns whose type changed (S20).
    """
    by = {d.column: d for d in decisions}
    out, changes = [], {}
    for f in df.schema.fields:
        d = by.get(f.name)
        e = None
        if d is not None and isinstance(f.dataType, T.StringType) and d.detected in ("numeric", "datetime", "boolean"):
            if d.detected == "boolean" and not text_booleans:
                e = None
            else:
                e = cast_expr(df, f.name, d.detected, d.fmt, d.target == "bigint", text_booleans)
        if e is None:
            out.append(col(f.name))
        else:
            out.append(e.alias(f.name))
    res = df.select(*out)
    for f_old, f_new in zip(df.schema.fields, res.schema.fields):
        if f_old.dataType != f_new.dataType:
            changes[f_old.name] = (f_old.dataType.simpleString(), f_new.dataType.simpleString())
    return res, changes


def apply_type_mapping(df: DataFrame, mapping: dict[str, str], *, text_booleans: bool = True,
                       order_by=None) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Forced logical types by (new) column name; unknown columns are ignored.

    Text forced to numeric takes bigint when all values are integers, else double (profile job);
    text forced to datetime takes the format found on the first values (sample job, needs ``order_by``)
    and falls back to ``yyyy-M-d``.
    """
    for c, t in mapping.items():
        if t not in LOGICAL_TYPES:
            raise ValueError(f"invalid type {t!r} for column {c!r}; valid: {LOGICAL_TYPES}")
    targets = {c: t for c, t in mapping.items() if c in df.columns}
    if not targets:
        return df, {}
    from ..functions.columns import field_type

    text_num = [c for c, t in targets.items() if t == "numeric" and isinstance(field_type(df, c), T.StringType)]
    text_dt = [c for c, t in targets.items() if t == "datetime" and isinstance(field_type(df, c), T.StringType)]
    integral = {}
    if text_num:
        p = profile(df.select(*[col(c) for c in text_num]), text_evidence=True)
        integral = {c: p.stats[c].get("not_long", 1) == 0 for c in text_num}
    fmts = _datetime_formats(df, text_dt, order_by) if (text_dt and order_by is not None) else {}
    out = []
    for f in df.schema.fields:
        t = targets.get(f.name)
        e = None
        if t is not None:
            e = cast_expr(df, f.name, t, fmts.get(f.name), integral.get(f.name), text_booleans)
        if e is None:
            out.append(col(f.name))
        elif t == "categorical":
            out.append(e.alias(f.name, metadata=CATEGORICAL_META))
        else:
            out.append(e.alias(f.name))
    res = df.select(*out)
    changes = {}
    for f_old, f_new in zip(df.schema.fields, res.schema.fields):
        if f_old.dataType != f_new.dataType:
            changes[f_old.name] = (f_old.dataType.simpleString(), f_new.dataType.simpleString())
    return res, changes


def type_changes_frame(spark, changes: dict[str, tuple[str, str]]) -> DataFrame:
    """(column, from_type, to_type)."""
    return spark.createDataFrame([(c, a, b) for c, (a, b) in changes.items()],
                                 "column string, from_type string, to_type string")
