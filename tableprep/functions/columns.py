"""Column-level helpers shared by every operator.

Everything here returns a native ``Column`` expression (no Python UDF), so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGRAL_TYPES + FRACTIONAL_TYPES + (T.DecimalType,)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Unicode-aware whitespace, like Python's str.strip()/str.split() (Java's \s is ASCII only).
WS = "(?U)\\s"


def q(name: str) -> str:
    """Backtick-quote a column name so dots and spaces survive resolution."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def field_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise KeyError(name)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numbers but not booleans (booleans are not filled with a mean, A10)."""
    return isinstance(dt, NUMERIC_TYPES)


def is_missing(c: Column, dt: T.DataType) -> Column:
    """pandas ``isnull``: null, and NaN for floating columns."""
    if isinstance(dt, FRACTIONAL_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_blank(c: Column) -> Column:
    """Text that is empty after stripping whitespace (an anchored match: stops at the first visible char)."""
    return c.rlike("^" + WS + "*$")


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, "^" + WS + "+|" + WS + "+$", "")


def typed_lit(v, dt: T.DataType) -> Column:
    """A literal of type ``dt`` from a collected Python value. Wall-clock timestamps go through text, so
    no session zone shifts them (``F.lit(datetime)`` would build a zoned timestamp first)."""
    if v is None:
        return F.lit(None).cast(dt)
    if isinstance(dt, T.TimestampNTZType) and hasattr(v, "isoformat"):
        return F.lit(v.isoformat(sep=" ")).cast(dt)
    return F.lit(v).cast(dt)


# --- numbers as text -------------------------------------------------------------

def number_to_text(c: Column) -> Column:
    """A whole double prints without ``.0``; other values as Python prints them.

    Guards NaN, infinity and magnitudes that do not fit a 38-digit decimal.
    """
    d = c.cast("double")
    whole = (~F.isnan(d)) & (F.abs(d) < F.lit(1e16)) & (d == F.floor(d))
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(whole, d.cast("decimal(38,0)").cast("string"))
        .otherwise(py_float_text(d))
    )


def py_float_text(d: Column) -> Column:
    """Text of a double the way Python's ``str(float)`` writes it: the shortest digits that read back as the
    same double, positional for exponents -4..15, else ``1.5e+16`` / ``1e-05``; ``nan``, ``inf``, ``-0.0``.

    The JVM's own text already has the shortest digits when it needs at most 15 significant digits; longer
    ones (where Java 17 may add a digit) are searched from 1 to 17 digits with a read-back check.
    """
    java = d.cast("string")                                   # 1863.84, 1.0E-5, 2.0000000000000002E23
    mant = F.regexp_extract(java, "^-?([0-9.]+)", 1)
    sig = F.regexp_replace(F.regexp_replace(F.regexp_replace(mant, "\\.", ""), "^0+", ""), "0+$", "")
    n_sig = F.greatest(F.length(sig), F.lit(1))

    def sci_with(p: Column) -> Column:                        # p significant digits, e.g. -1.2345e+03
        return F.call_function("format_string", F.concat(F.lit("%."), (p - 1).cast("string"), F.lit("e")), d)

    shortest = F.element_at(
        F.filter(F.transform(F.sequence(F.lit(1), F.lit(17)), sci_with), lambda t: t.cast("double") == d), 1)
    sci = F.when(n_sig <= 15, sci_with(n_sig)).otherwise(shortest)

    def layout(t: Column) -> Column:
        neg = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        digits = F.regexp_replace(F.regexp_extract(t, "^-?([0-9.]+)e", 1), "\\.", "")
        e = F.regexp_extract(t, "e([+-][0-9]+)$", 1).cast("int")
        k = F.length(digits)
        int_part = F.rpad(digits, F.greatest(k, e + 1), "0").substr(F.lit(1), e + 1)
        frac = F.when(k > e + 1, digits.substr(e + 2, F.lit(32))).otherwise(F.lit("0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        plain = F.concat(neg, F.when(e >= 0, F.concat(int_part, F.lit("."), frac)).otherwise(small))
        return F.when((e >= -4) & (e < 16), plain).otherwise(t)   # Java's %e already reads 1.5e+16, 1e-05

    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), F.lit("nan"))
        .when(d == F.lit(float("inf")), F.lit("inf"))
        .when(d == F.lit(float("-inf")), F.lit("-inf"))
        .when(d == 0, d.cast("string"))  # 0.0 or -0.0, as Python
        .otherwise(F.element_at(F.transform(F.array(sci), layout), 1))   # binds sci once
    )


def as_text(c: Column, dt: T.DataType) -> Column:
    """A cell as the text ``str(value)`` gives in the reference (``astype(str)``)."""
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, FRACTIONAL_TYPES):
        return py_float_text(c.cast("double"))
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


# --- guarded casts ---------------------------------------------------------------------

# Text that parses as a number (pandas to_numeric semantics, ASCII digits).
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
NAN_PATTERN = r"(?i)^\s*[+-]?nan\s*$"      # those of them that are missing once cast
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


def parses_as_number(c: Column) -> Column:
    """True when the text is a number; blank text is treated as missing (null result)."""
    return F.when(c.isNull() | is_blank(c), F.lit(None).cast("boolean")).otherwise(c.rlike(NUMBER_PATTERN))


ASCII_WS = " \t\n\r\x0b\x0c"


def to_number(c: Column, integral: bool) -> Column:
    """Text to bigint or double, bad values to null (never throws under ANSI)."""
    s = F.btrim(c, F.lit(ASCII_WS))   # a character-set trim, no regular expression
    ok = c.rlike(NUMBER_PATTERN)
    return F.when(ok, s.try_cast("bigint" if integral else "double"))


def is_long_text(c: Column) -> Column:
    """Integer text that fits a bigint; only texts of 19+ digits can overflow, so only they are cast."""
    s = F.btrim(c, F.lit(ASCII_WS))
    return c.rlike(INTEGER_PATTERN) & ((F.length(s) < 19) | s.try_cast("bigint").isNotNull())


# Datetime text formats tried in this order; one format per column.
DATETIME_FORMATS = (
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
    "yyyy/M/d H:m:s",
    "yyyy/M/d H:m",
    "yyyy/M/d",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "M/d/yyyy",
    "yyyyMMdd",
    "yyyy.M.d",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyy-M-d'T'H:m:s.SSSSSSXXX",
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d H:m:s.SSSSSSXXX",
    "yyyy-M-d H:m:sXXX",
)


def to_datetime(c: Column, fmt: str) -> Column:
    """Text to a wall-clock timestamp (no time zone), bad values to null.

    The ``try_`` parse decides validity (it never throws under ANSI); the value is then parsed straight
    to ``timestamp_ntz`` so no session zone (and no DST gap) can shift it.
    """
    s = strip_ws(c)
    parsed = F.try_to_timestamp(s, F.lit(fmt))
    if "X" in fmt:
        # text with a zone offset names an instant: keep its UTC wall clock, built from epoch microseconds
        return utc_wall_clock(parsed)
    return F.when(parsed.isNotNull(), F.to_timestamp_ntz(s, F.lit(fmt)))


def utc_wall_clock(ts: Column) -> Column:
    """The UTC wall clock of an instant as ``timestamp_ntz``, independent of the session zone."""
    us = F.unix_micros(ts)
    day = F.floor(us / F.lit(86_400_000_000)).cast("int")
    rem = us - day.cast("long") * 86_400_000_000
    d = F.date_from_unix_date(day)
    secs = (rem % 60_000_000).cast("decimal(16,6)") / 1_000_000
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), (rem / 3_600_000_000).cast("int"),
                                ((rem % 3_600_000_000) / 60_000_000).cast("int"), secs)


# Boolean text pairs (true word, false word).
BOOLEAN_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("是", "否"))


def to_boolean(c: Column) -> Column:
    """S15 with ``text_booleans=True``: lower-cased words of the pairs to booleans."""
    low = F.lower(strip_ws(c))
    trues = [p[0] for p in BOOLEAN_PAIRS]
    falses = [p[1] for p in BOOLEAN_PAIRS]
    return F.when(low.isin(trues), F.lit(True)).when(low.isin(falses), F.lit(False))
