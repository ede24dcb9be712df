"""Sources and sinks (IO1-IO8)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

# Text read as missing, like pandas read_csv's default na_values.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

READERS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}
WRITERS = ("csv", "json", "parquet", "orc")


def _files(path: str) -> list[str]:
    """The names of the files in a folder, on whatever file system Spark reads it from; none where there is no folder."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(p))


def detect_format(path: str) -> str:
    """IO3: format from the extension (lower-cased); unknown extensions are an error."""
    p = path.rstrip("/")
    ext = os.path.splitext(p)[1].lower().lstrip(".")
    if ext in ("xlsx", "xls"):
        raise ValueError(f"unsupported file format: {path} (convert Excel files to CSV or Parquet first)")
    if ext in READERS:
        return ext
    for f in _files(p):     # a folder written by Spark: look at its part files
        e = os.path.splitext(f)[1].lower().lstrip(".")
        if e in READERS:
            return e
    raise ValueError(f"unsupported file format: {path} (for a folder without an extension pass fmt=...)")


def normalize_na(df: DataFrame, tokens: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """IO4: text cells equal to a missing token become null (one projection)."""
    toks = NA_TOKENS if tokens is None else tokens
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = [F.when(~col(c).isin(toks), col(c)).alias(c) if c in cols else col(c) for c in df.columns]
    return df.select(*out)


BAD = "__malformed_record"
NOTHING = "__no_column"
PROBLEM_SCHEMA = "record string, problem string"


@dataclass(frozen=True)
class Checked:
    """What was read: the table's rows, and the records that aren't rows of it. Lazy, both."""
    data: DataFrame
    malformed: DataFrame        # (record, problem): the record's text as it stands in the file
    strict: DataFrame           # the same rows as ``data``; a job that meets a malformed record fails

    def count_malformed(self) -> int:
        return self.malformed.count()


def _split(df: DataFrame, is_bad, problem: str) -> Checked:
    """``df``, read with its malformed records in the column ``BAD``, as ``Checked``."""
    names = [c for c in df.columns if c not in (BAD, NOTHING)]
    # Spark refuses plans that read nothing but the column of malformed records
    with_others = F.length(F.coalesce(*[col(c).cast("string") for c in df.columns if c != BAD], F.lit(""))) >= 0
    is_bad = is_bad & with_others
    refused = F.raise_error(F.concat(F.lit(f"malformed record ({problem}): "), F.substring(BAD, 1, 200))).cast("boolean")
    return Checked(df.where(~is_bad).select(*map(col, names)),
                   df.where(is_bad).select(F.col(BAD).alias("record"), F.lit(problem).alias("problem")),
                   df.where(F.when(is_bad, refused).otherwise(F.lit(True))).select(*map(col, names)))


def _whole(df: DataFrame) -> Checked:
    return Checked(df, df.sparkSession.createDataFrame([], PROBLEM_SCHEMA), df)


def checked_csv(spark: SparkSession, path: str, *, na_tokens: list[str] | None = None, multiline: bool = False) -> Checked:
    """IO1 with the rows that have cells beyond the header's split off. A row with fewer cells has gaps at its end, as in
    pandas; a further cell without anything in it (a comma at the end) is no cell."""
    read = spark.read.option("multiLine", multiline).option("escape", '"')
    header = read.option("header", True).csv(path).schema
    if not header.names:
        return _whole(normalize_na(read.option("header", True).csv(path), na_tokens))
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in header.fields] + [T.StructField(BAD, T.StringType())])
    # Spark marks short and long rows alike, and only while it reads all cells; the few marked ones are parsed once more
    df = spark.read.schema(schema).option("header", True).option("multiLine", multiline).option("escape", '"').option("enforceSchema", True) \
        .option("columnNameOfCorruptRecord", BAD).option("columnPruning", False).csv(path)
    df = df.toDF(*[f"__c{i}" for i in range(len(header.names))], BAD)
    beyond = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header.names) + 1)])
    again = F.from_csv(F.col(BAD), beyond.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    long_row = F.coalesce(F.col(BAD).isNotNull() & again[f"c{len(header.names)}"].isNotNull(), F.lit(False))
    out = _split(df, long_row, "cells beyond the header")
    named = lambda x: normalize_na(x.toDF(*header.names), na_tokens)
    return Checked(named(out.data), out.malformed, named(out.strict))


def read_csv(spark: SparkSession, path: str, *, na_tokens: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """IO1: header row, all columns as text, missing tokens to null; types are inferred later.

    Files are split across tasks. ``multiline=True`` allows line breaks inside quoted fields, but then
    every file is read by a single task, so keep it for inputs that need it. A row with cells beyond the header's fails the
    job that meets it; ``read_checked`` splits such rows off instead.
    """
    return checked_csv(spark, path, na_tokens=na_tokens, multiline=multiline).strict


def checked_json(spark: SparkSession, path: str, *, array: bool | None = None) -> Checked:
    """IO2 with the records that aren't JSON objects split off (of an array that can't be parsed, the file's text)."""
    df = _json(spark, path, array)
    if BAD not in df.columns:
        return _whole(df)
    if df.columns == [BAD]:     # no record is one
        df = _json(spark, path, array, f"{NOTHING} string, {BAD} string")
    return _split(df, F.col(BAD).isNotNull(), "not a JSON object")


def read_json(spark: SparkSession, path: str, *, array: bool | None = None) -> DataFrame:
    """IO2: JSON records. A record that isn't a JSON object fails the job that meets it; ``read_checked`` splits them off."""
    return checked_json(spark, path, array=array).strict


def _json(spark: SparkSession, path: str, array: bool | None = None, schema: str | None = None) -> DataFrame:
    """A JSON array of records (``multiLine``: one task per file, inherent to the format) or one
    record per line (splittable; what ``write_table`` produces). Without ``array`` the first line that isn't blank decides
    (a file of records can't begin with a bracket), read through Spark so any file system works."""
    if array is None:
        # a file may be one line: only its first characters leave the task
        first = spark.read.text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).where("c <> ''").limit(1).collect()
        array = bool(first) and first[0][0] == "["
    return spark.read.option("multiLine", bool(array)).option("columnNameOfCorruptRecord", BAD).json(path, schema)


def read_checked(spark: SparkSession, path: str, fmt: str | None = None) -> Checked:
    """IO3 with malformed records as a side output; formats with a schema of their own have none."""
    f = (fmt or detect_format(path)).lower()
    if f == "csv":
        return checked_csv(spark, path)
    if f == "json":
        return checked_json(spark, path)
    return _whole(read_table(spark, path, f))


def check_export_format(fmt: str) -> str:
    """IO7: an unknown export format is an error before any job starts."""
    if fmt.lower() not in WRITERS:
        raise ValueError(f"unsupported export format: {fmt}")
    return fmt.lower()


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """IO3: choose the reader by extension or ``fmt``."""
    f = (fmt or detect_format(path)).lower()
    if f == "csv":
        return read_csv(spark, path)
    if f == "json":
        return read_json(spark, path)
    if f in READERS:
        return spark.read.format(f).load(path)
    raise ValueError(f"unsupported file format: {f}")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """IO5-IO7: CSV with header (no BOM), JSON records one per line (UTF-8, no escaping), Parquet, ORC."""
    f = check_export_format(fmt)
    w = df.write.mode(mode)
    if f == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif f == "json":
        w.option("ignoreNullFields", False).json(path)
    else:
        w.format(f).save(path)
