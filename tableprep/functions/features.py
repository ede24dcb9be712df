"""Feature expressions (F1-F8). Null input gives null output (A3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import is_blank, is_missing


def is_null_flag(c: Column, dt: T.DataType) -> Column:
    """1 where the cell is missing (null or NaN), else 0."""
    return is_missing(c, dt).cast("int")


def absolute(c: Column) -> Column:
    """F2."""
    return F.abs(c)


def text_length(c: Column) -> Column:
    """length in characters (code points)."""
    return F.char_length(c).cast("bigint")


def word_count(c: Column) -> Column:
    """number of whitespace-separated words (runs of non-space characters; no array is built)."""
    return F.regexp_count(c, F.lit("(?U)\\S+")).cast("bigint")


def is_empty_flag(c: Column) -> Column:
    """1 where the text is blank after stripping, else 0."""
    return is_blank(c).cast("int")


def year(c: Column) -> Column:
    """F6."""
    return F.year(c)


def month(c: Column) -> Column:
    """F7."""
    return F.month(c)


def day_of_week(c: Column) -> Column:
    """F8: Monday = 0 ... Sunday = 6."""
    return F.weekday(c)
