"""Table validation (V1-V10): one profile aggregate and a few checks on names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import Profile, profile
from .sample import _order_cols

MAX_ROWS = 1_000_000        # fixed value: the row limit, for callers that want one
MAX_COLUMNS = 1_000         # fixed value: the column limit, likewise
MAX_MISSING_RATE = 0.8      # fixed value: overall missing-rate cut-off


@dataclass
class Validation:
    valid: bool
    errors: list[tuple[str, str, str]] = field(default_factory=list)     # (code, subject, value)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)
    prof: Profile | None = None

    @property
    def stats(self) -> dict:
        if self.prof is None:
            return {}
        return {"rows": self.prof.rows, "columns": self.prof.n_columns, "missing_rate": self.prof.missing_rate}

    def report(self, spark) -> DataFrame:
        """V9: (level, code, subject, value)."""
        rows = [("error", c, s, v) for c, s, v in self.errors] + [("warning", c, s, v) for c, s, v in self.warnings]
        if self.prof is not None:
            rows += [("stat", "rows", "", str(self.prof.rows)), ("stat", "columns", "", str(self.prof.n_columns)),
                     ("stat", "missing_rate", "", repr(self.prof.missing_rate))]
        return spark.createDataFrame(rows, "level string, code string, subject string, value string")


def validate(df: DataFrame | None, *, max_rows: int | None = None, max_columns: int | None = None,
             max_missing_rate: float = MAX_MISSING_RATE, prof: Profile | None = None) -> Validation:
    """V1-V8. All errors but an empty table are collected before returning."""
    if df is None:
        return Validation(False, [("no_data", "", "")])
    if not df.columns:
        return Validation(False, [("empty_table", "", "0 columns")])
    if prof is None:
        from .standardize import drop_duplicate_columns

        # duplicate names cannot be resolved by Spark; profile the first of each (V4 reports the rest)
        prof = profile(drop_duplicate_columns(df))
    if prof.rows == 0:
        return Validation(False, [("empty_table", "", "0 rows")], prof=prof)
    errors, warnings = [], []
    if max_rows is not None and prof.rows > max_rows:
        errors.append(("too_many_rows", "", f"{prof.rows} > {max_rows}"))
    if max_columns is not None and prof.n_columns > max_columns:
        errors.append(("too_many_columns", "", f"{prof.n_columns} > {max_columns}"))
    seen, folded = set(), set()
    for c in df.columns:
        if c in seen:
            errors.append(("duplicate_column", c, "exact"))
        elif c.lower() in folded:
            errors.append(("duplicate_column", c, "case-insensitive"))
        seen.add(c)
        folded.add(c.lower())
    for c in prof.empty_columns():
        warnings.append(("empty_column", c, "all missing"))
    if prof.missing_rate > max_missing_rate:
        errors.append(("missing_rate", "", f"{prof.missing_rate:.2%}"))
    return Validation(not errors, errors, warnings, prof)


def basic_stats(df: DataFrame) -> DataFrame:
    """V7 as a one-row frame, computed by one aggregate job on the cluster."""
    from ..functions.columns import col, field_type, is_missing

    n_cols = len(df.columns)
    # the missing cells of a row as one flat array: a sum of many columns would nest as deep as the table is wide
    gaps = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(is_missing(col(c), field_type(df, c)), 1) for c in df.columns]))
    total = F.coalesce(F.sum(F.size(gaps)), F.lit(0))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(n_cols).cast("bigint").alias("columns"),
        total.cast("bigint").alias("missing_cells"),
        F.try_divide(total, rows * F.lit(n_cols)).alias("missing_rate"),
    )


def preview(df: DataFrame, order_by, n: int = 10) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (a top-k: each task keeps ``n`` rows)."""
    return df.orderBy(*_order_cols(order_by)).limit(n)


def preview_counts(df: DataFrame) -> DataFrame:
    """Row, column and missing-cell counts shown above a preview (one row)."""
    return basic_stats(df).select("rows", "columns", "missing_cells")
