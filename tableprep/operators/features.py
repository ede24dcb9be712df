"""Feature extraction (F9): numeric, text and datetime features in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import features as fx
from ..functions.columns import col, is_numeric_type


@dataclass(frozen=True)
class FeatureOptions:
    enable_extraction: bool = False
    extract_numeric_stats: bool = True
    extract_text_features: bool = True
    extract_datetime_features: bool = True


def feature_columns(df: DataFrame, has_values: dict[str, bool], opts: FeatureOptions):
    """(new name, expression) pairs in the order numeric, text, datetime.

    ``has_values`` tells which columns hold at least one non-missing value (from a profile or sample).
    Categorical columns (metadata from S16) get no text features.
    """
    out = []
    fields = [f for f in df.schema.fields if has_values.get(f.name, False)]
    if opts.extract_numeric_stats:
        for f in fields:
            if is_numeric_type(f.dataType):
                c = col(f.name)
                out.append((f"{f.name}_is_null", fx.is_null_flag(c, f.dataType)))
                out.append((f"{f.name}_abs", fx.absolute(c)))
    if opts.extract_text_features:
        for f in fields:
            if isinstance(f.dataType, T.StringType) and f.metadata.get("logical") != "categorical":
                c = col(f.name)
                out.append((f"{f.name}_length", fx.text_length(c)))
                out.append((f"{f.name}_word_count", fx.word_count(c)))
                out.append((f"{f.name}_is_empty", fx.is_empty_flag(c)))
    if opts.extract_datetime_features:
        for f in fields:
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                c = col(f.name)
                out.append((f"{f.name}_year", fx.year(c)))
                out.append((f"{f.name}_month", fx.month(c)))
                out.append((f"{f.name}_dayofweek", fx.day_of_week(c)))
    return out


def extract_features(df: DataFrame, has_values: dict[str, bool] | None = None,
                     opts: FeatureOptions = FeatureOptions(enable_extraction=True)) -> tuple[DataFrame, list[str]]:
    """the table with feature columns appended, and the list of new names. Off unless enabled."""
    if not opts.enable_extraction:
        return df, []
    if has_values is None:
        from .profile import profile

        p = profile(df)
        has_values = {c: p.non_missing(c) > 0 for c in p.columns}
    feats = feature_columns(df, has_values, opts)
    taken = set(df.columns)
    feats = [(n, e) for n, e in feats if n not in taken]
    return df.select(*[col(c) for c in df.columns], *[e.alias(n) for n, e in feats]), [n for n, _ in feats]

