"""Column masking (K16-K18): all masked columns in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_text, col, field_type, is_missing
from ..functions.masks import REMOVED_MARKER, mask
from .sample import first_values


@dataclass(frozen=True)
class MaskSpec:
    masking_type: str
    strategy: str = "partial"


@dataclass(frozen=True)
class MaskOptions:
    seed: int | None = None      # of random masks; None: another one for each call
    salt: str = ""
    hash_len: int = 8
    marker: str = REMOVED_MARKER


def mask_expr(df: DataFrame, name: str, spec: MaskSpec, opts: MaskOptions = MaskOptions()):
    """The masked value of one column as text; missing cells stay null (A3)."""
    dt = field_type(df, name)
    c = col(name)
    text = F.when(~is_missing(c, dt), as_text(c, dt))
    return mask(text, spec.masking_type, spec.strategy, seed=opts.seed, salt=opts.salt,
                hash_len=opts.hash_len, marker=opts.marker)


def mask_columns(df: DataFrame, specs: dict[str, MaskSpec], opts: MaskOptions = MaskOptions()) -> DataFrame:
    """Replace each listed column by its masked text, keeping column order. One ``select``."""
    unknown = [c for c in specs if c not in df.columns]
    if unknown:
        raise KeyError(f"columns to mask not in the table: {unknown}")
    out = [mask_expr(df, c, specs[c], opts).alias(c) if c in specs else col(c) for c in df.columns]
    return df.select(*out)


def _mask_long(samples: DataFrame, specs: dict[str, MaskSpec], opts: MaskOptions) -> F.Column:
    """CASE over the column name: the mask of each column applied to a long ``value``."""
    v = F.col("value")
    e = F.lit(None).cast("string")
    for name, spec in specs.items():
        m = mask(v, spec.masking_type, spec.strategy, seed=opts.seed, salt=opts.salt,
                 hash_len=opts.hash_len, marker=opts.marker)
        e = F.when(F.col("column") == name, m).otherwise(e)
    return e


def mask_preview(df: DataFrame, specs: dict[str, MaskSpec], order_by, n: int = 5,
                 opts: MaskOptions = MaskOptions()) -> DataFrame:
    """Up to ``n`` (original, masked) pairs per column, first non-missing values in order."""
    s = first_values(df, list(specs), order_by, n)
    return s.select("column", "pos", F.col("value").alias("original"), _mask_long(s, specs, opts).alias("masked"))


def mask_summary(df: DataFrame, specs: dict[str, MaskSpec], order_by, *, include_originals: bool = False,
                 n: int = 3, opts: MaskOptions = MaskOptions()) -> DataFrame:
    """Per masked column its type, strategy and ``n`` before/after values.

    Clear values are left out unless ``include_originals`` (A9).
    """
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(c, s.masking_type, s.strategy) for c, s in specs.items()], "column string, masking_type string, strategy string"
    )
    prev = mask_preview(df, specs, order_by, n, opts)
    pairs = F.sort_array(F.collect_list(F.struct("pos", "original", "masked")))
    agg = prev.groupBy("column").agg(pairs.alias("pairs"))
    masked = F.transform(F.col("pairs"), lambda p: p["masked"])
    cols = [F.col("column"), "masking_type", "strategy", masked.alias("masked_preview")]
    if include_originals:
        cols.append(F.transform(F.col("pairs"), lambda p: p["original"]).alias("original_preview"))
    # the preview frame holds at most n rows per masked column, so collect_list is bounded
    return meta.join(agg, "column", "left").select(*cols)
