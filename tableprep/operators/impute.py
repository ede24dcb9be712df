"""Missing-value handling.

``fit_fills`` gathers every statistic in as few jobs as possible:

* one aggregate for missing counts and means, each computed under the row filter of the ``drop``
  columns that come before it (M10: columns are treated left to right on the running table);
* one long-form job per value type for modes (``groupBy(column, value).count()``, partially
  aggregated, then the top count per column);
* the exact median by narrowing (``quantile.exact_median``), or ``percentile_approx`` if asked.

``apply_fills`` is a lazy plan: constant fills are one projection per segment, ordered fills of a
segment share one two-phase window plan, and each ``drop`` is a filter between segments.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    FRACTIONAL_TYPES,
    INTEGRAL_TYPES,
    col,
    field_type,
    is_missing,
    is_numeric_type,
    typed_lit,
)
from .ordered_fill import boundaries, default_buckets, ordered_fill
from .profile import Profile, profile
from .quantile import exact_medians

STRATEGIES = ("mean", "median", "mode", "forward_fill", "backward_fill", "drop", "custom")
ORDERED = ("forward_fill", "backward_fill")


@dataclass(frozen=True)
class FillOptions:
    default_strategy: str = "mean"
    column_strategies: dict = field(default_factory=dict)
    custom_fill_values: dict = field(default_factory=dict)
    missing_threshold: float = 0.9
    approx_median: bool = False

    def __post_init__(self):
        for c, s in [("<default>", self.default_strategy), *self.column_strategies.items()]:
            if s not in STRATEGIES:
                raise ValueError(f"invalid missing strategy {s!r} for {c}; valid: {STRATEGIES}")
        if not 0 <= self.missing_threshold <= 1:
            raise ValueError(f"missing_threshold is a share from 0 to 1, not {self.missing_threshold}")


@dataclass(frozen=True)
class FillStep:
    column: str
    kind: str                 # constant, mean, median, mode, forward_fill, backward_fill, drop
    value: object = None      # literal for constant kinds
    missing: int = 0          # missing cells of the column on the running table


@dataclass
class FillPlan:
    dropped_columns: list[str]
    steps: list[FillStep]
    missing_before: int

    def log(self) -> list[str]:
        out = []
        if self.dropped_columns:
            out.append(f"dropped sparse columns: {self.dropped_columns}")
        for s in self.steps:
            out.append(f"{s.column}: {s.kind}, {s.missing} missing")    # never the value: it may be a person's
        return out


def _strategy(c: str, opts: FillOptions) -> str:
    if c in opts.custom_fill_values:
        return "constant"
    return opts.column_strategies.get(c, opts.default_strategy)


def _literal(v, dt: T.DataType) -> Column:
    """A fill value checked against the column type (M2)."""
    if isinstance(dt, T.StringType):
        return F.lit(str(v))
    if isinstance(dt, T.BooleanType):
        if not isinstance(v, bool):
            raise ValueError(f"fill value {v!r} is not a boolean")
        return F.lit(v)
    if isinstance(dt, INTEGRAL_TYPES + FRACTIONAL_TYPES + (T.DecimalType,)):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise ValueError(f"fill value {v!r} is not a number")
        return F.lit(v)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(v, (datetime, date)):
            return typed_lit(v, dt)
        return F.lit(str(v)).try_cast(dt)
    return F.lit(v)


def modes(df: DataFrame, specs: dict[str, Column | None]) -> dict[str, object]:
    """Most frequent non-missing value per column, ties to the smallest (M5).

    ``specs`` maps a column to an optional row condition (earlier drops). Columns of one type share one
    unpivot; both group-bys are partially aggregated, so a value held by a third of all rows costs one
    row per task before the shuffle.
    """
    if not specs:
        return {}
    groups: dict[str, list[str]] = {}
    for c in specs:
        groups.setdefault(field_type(df, c).simpleString(), []).append(c)
    out = {}
    for _, cols in groups.items():
        proj = []
        for i, c in enumerate(cols):
            cond = ~is_missing(col(c), field_type(df, c))
            if specs[c] is not None:
                cond = cond & specs[c]
            proj.append(F.when(cond, col(c)).alias(f"__v{i}"))
        long = df.select(*proj).unpivot([], [f"__v{i}" for i in range(len(cols))], "slot", "value").where(
            F.col("value").isNotNull())
        counts = long.groupBy("slot", "value").count()
        best = counts.groupBy("slot").agg(F.min_by("value", F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("mode"))
        names = {f"__v{i}": c for i, c in enumerate(cols)}
        for r in best.collect():
            out[names[r["slot"]]] = r["mode"]
    return out


def fit_fills(df: DataFrame, opts: FillOptions = FillOptions(), prof: Profile | None = None,
              identifiers: frozenset = frozenset()) -> FillPlan:
    """``identifiers``: columns of phone or ID numbers, which take no mean or median (their gaps stay)."""
    prof = prof or profile(df)
    rows = prof.rows
    # M1: drop columns above the missing threshold
    dropped = [c for c in prof.columns if rows and prof.missing[c] / rows > opts.missing_threshold]
    cols = [c for c in prof.columns if c not in dropped]
    dtypes = {c: field_type(df, c) for c in cols}
    # Strategies, and the row condition in force for each column
    strat = {c: _strategy(c, opts) for c in cols}
    strat = {c: "keep" if c in identifiers and s in ("mean", "median") else s for c, s in strat.items()}
    cond: dict[str, Column | None] = {}
    running = None
    for c in cols:
        cond[c] = running
        if strat[c] == "drop":
            nm = ~is_missing(col(c), dtypes[c])
            running = nm if running is None else (running & nm)

    def under(c: str, e: Column) -> Column:
        return e if cond[c] is None else F.when(cond[c], e)

    # Only columns with gaps in the whole table can have gaps under a row filter; others need nothing.
    gappy = [c for c in cols if prof.missing[c] > 0]
    aggs, keys = [], []
    for c in gappy:
        if cond[c] is not None:
            aggs.append(F.count(under(c, F.when(is_missing(col(c), dtypes[c]), 1))).alias(f"m{len(keys)}"))
            keys.append((c, "missing"))
        if strat[c] == "mean" and is_numeric_type(dtypes[c]):
            aggs.append(F.avg(under(c, F.when(~is_missing(col(c), dtypes[c]), col(c)))).alias(f"m{len(keys)}"))
            keys.append((c, "mean"))
    stats: dict[tuple, object] = {(c, "missing"): prof.missing[c] for c in cols}
    if aggs:
        r = df.agg(*aggs).collect()[0]
        for i, k in enumerate(keys):
            stats[k] = r[f"m{i}"]
    need = [c for c in cols if (stats[(c, "missing")] or 0) > 0]
    mode_cols = {c: cond[c] for c in need if strat[c] == "mode"}
    mode_vals = modes(df, mode_cols)
    med_cols = [c for c in need if strat[c] == "median" and is_numeric_type(dtypes[c])]
    if med_cols and opts.approx_median:
        aggs = [F.percentile_approx(F.when(~is_missing(col(c), dtypes[c]) & (cond[c] if cond[c] is not None else F.lit(True)),
                                           col(c).cast("double")), 0.5, 100000).alias(f"p{i}") for i, c in enumerate(med_cols)]
        r = df.agg(*aggs).collect()[0]
        med_vals = {c: r[f"p{i}"] for i, c in enumerate(med_cols)}
    elif med_cols:   # all exact medians in lockstep: a few jobs whatever the number of columns
        med_vals = exact_medians(df, {c: (col(c), cond[c]) for c in med_cols})
    else:
        med_vals = {}
    steps = []
    for c in need:
        s, dt, miss = strat[c], dtypes[c], int(stats[(c, "missing")])
        if s == "constant":
            _literal(opts.custom_fill_values[c], dt)  # type check now, not at run time
            steps.append(FillStep(c, "constant", opts.custom_fill_values[c], miss))
        elif s == "mean" and is_numeric_type(dt):
            steps.append(FillStep(c, "mean", stats[(c, "mean")], miss))
        elif s == "median" and is_numeric_type(dt):
            steps.append(FillStep(c, "median", med_vals[c], miss))
        elif s == "mode":
            if c in mode_vals:
                steps.append(FillStep(c, "mode", mode_vals[c], miss))
        elif s in ORDERED or s == "drop":
            steps.append(FillStep(c, s, None, miss))
        # mean/median on non-numeric columns and custom without a value do nothing (M9)
    return FillPlan(dropped, steps, prof.total_missing)


def _fill_value(df: DataFrame, step: FillStep) -> Column:
    dt = field_type(df, step.column)
    if step.kind in ("mean", "median"):
        lit = F.lit(None).cast("double") if step.value is None else F.lit(float(step.value))
        return F.when(is_missing(col(step.column), dt), lit).otherwise(col(step.column).cast("double")) \
            if not isinstance(dt, FRACTIONAL_TYPES) else F.when(is_missing(col(step.column), dt), lit).otherwise(col(step.column))
    lit = _literal(step.value, dt) if step.kind == "constant" else typed_lit(step.value, dt)
    return F.when(is_missing(col(step.column), dt), lit).otherwise(col(step.column))


def apply_fills(df: DataFrame, plan: FillPlan, order_by=None, partition_by=None, buckets: int | None = None) -> DataFrame:
    """The fill plan as one lazy DataFrame plan."""
    x = df.drop(*plan.dropped_columns) if plan.dropped_columns else df
    segment: list[FillStep] = []
    bounds = None
    if any(s.kind in ORDERED for s in plan.steps):
        # one list of boundaries of this table for all its ordered fills (any list is right, dropped rows only thin it out)
        bounds = boundaries(x, order_by, buckets or default_buckets(x))

    def flush(x: DataFrame, seg: list[FillStep]) -> DataFrame:
        consts = {s.column: s for s in seg if s.kind not in ORDERED}
        if consts:
            x = x.select(*[_fill_value(x, consts[c]).alias(c) if c in consts else col(c) for c in x.columns])
        for kind, direction in (("forward_fill", "forward"), ("backward_fill", "backward")):
            cs = [s.column for s in seg if s.kind == kind]
            if cs:
                x = ordered_fill(x, cs, order_by, direction, partition_by, buckets, bounds=bounds)
        return x

    for step in plan.steps:
        if step.kind == "drop":
            x = flush(x, segment)
            segment = []
            x = x.where(~is_missing(col(step.column), field_type(x, step.column)))
        else:
            segment.append(step)
    return flush(x, segment)


def fill_missing(df: DataFrame, opts: FillOptions = FillOptions(), order_by=None, partition_by=None,
                 prof: Profile | None = None) -> tuple[DataFrame, FillPlan]:
    """fit + apply in one call."""
    plan = fit_fills(df, opts, prof)
    return apply_fills(df, plan, order_by, partition_by), plan


def missing_reduction(plan: FillPlan, filled: DataFrame) -> int:
    """Missing cells before the step minus missing cells after it (one job)."""
    return plan.missing_before - profile(filled).total_missing
