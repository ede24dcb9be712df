"""Table profile: one aggregate per table version, reused by every later step.

The aggregate is split into chunks of columns. Each chunk reads only its own columns
(Catalyst prunes the rest), so a 1,000-column table is still read about once in total, and no
generated method grows past the codegen limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    BOOLEAN_PAIRS,
    INTEGRAL_TYPES,
    NAN_PATTERN,
    NUMBER_PATTERN,
    col,
    is_blank,
    is_long_text,
    is_missing,
)

MAX_EXPRS_PER_JOB = 400


@dataclass
class Profile:
    rows: int
    columns: list[str]
    dtypes: dict[str, T.DataType]
    missing: dict[str, int]
    stats: dict[str, dict] = field(default_factory=dict)

    @property
    def n_columns(self) -> int:
        return len(self.columns)

    @property
    def total_missing(self) -> int:
        return sum(self.missing.values())

    @property
    def cells(self) -> int:
        return self.rows * self.n_columns

    @property
    def missing_rate(self) -> float:
        return self.total_missing / self.cells if self.cells else 0.0

    def non_missing(self, c: str) -> int:
        return self.rows - self.missing[c]

    def empty_columns(self) -> list[str]:
        return [c for c in self.columns if self.missing[c] == self.rows]


def at_least_distinct(c) -> F.Column:
    """A number of distinct values that ``c`` has at least: marked places of a bitmap of 32,768 hash values. A state of 4 KB a
    column whatever its values, merged by OR; two values may share a place, so it never counts too many."""
    place = F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(32768)))
    return F.bitmap_count(F.bitmap_construct_agg(place))


def _column_exprs(name: str, dt: T.DataType, text_evidence: bool, distinct_floor: bool):
    c = col(name)
    out = [("missing", F.count(F.when(is_missing(c, dt), 1)))]
    if text_evidence and isinstance(dt, T.StringType):
        nonblank = c.isNotNull() & ~is_blank(c)
        out += [
            ("blank", F.count(F.when(c.isNotNull() & is_blank(c), 1))),
            ("bad_number", F.count(F.when(nonblank & ~c.rlike(NUMBER_PATTERN), 1))),
            ("nan_text", F.count(F.when(c.rlike(NAN_PATTERN), 1))),
            ("not_long", F.count(F.when(nonblank & ~is_long_text(c), 1))),
        ]
        low = F.lower(c)
        short = F.char_length(c) <= max(len(w) for p in BOOLEAN_PAIRS for w in p)  # never lower-case long texts
        for i, pair in enumerate(BOOLEAN_PAIRS):
            hit = F.when(short, low.isin(list(pair))).otherwise(F.lit(False))
            out.append((f"bool_{i}", F.min(F.when(c.isNotNull(), hit.cast("int")))))
        if distinct_floor:
            out.append(("distinct_floor", at_least_distinct(c)))
    elif text_evidence and isinstance(dt, INTEGRAL_TYPES):
        out += [("min", F.min(c)), ("max", F.max(c))]
    return out


def profile(
    df: DataFrame,
    *,
    text_evidence: bool = False,
    distinct_floor: bool = False,
    max_exprs: int = MAX_EXPRS_PER_JOB,
) -> Profile:
    """Row count and missing counts of every column; optional type evidence for text columns."""
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    specs = []  # (column index, stat key, expr)
    for i, (name, dt) in enumerate(fields):
        for key, e in _column_exprs(name, dt, text_evidence, distinct_floor):
            specs.append((i, key, e))
    rows = None
    missing: dict[str, int] = {}
    stats: dict[str, dict] = {name: {} for name, _ in fields}
    chunks = [specs[k : k + max_exprs] for k in range(0, len(specs), max_exprs)] or [[]]
    for chunk in chunks:
        exprs = [F.count(F.lit(1)).alias("__rows")] + [e.alias(f"s{j}") for j, (_, _, e) in enumerate(chunk)]
        r = df.agg(*exprs).collect()[0]
        rows = r["__rows"]
        for j, (i, key, _) in enumerate(chunk):
            name = fields[i][0]
            v = r[f"s{j}"]
            if key == "missing":
                missing[name] = int(v)
            else:
                stats[name][key] = v
    return Profile(
        rows=int(rows or 0),
        columns=[n for n, _ in fields],
        dtypes={n: dt for n, dt in fields},
        missing=missing,
        stats=stats,
    )
