"""Small shared helpers of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, remove_folder, write_and_read

WS = " \t\n\x0b\x0c\r"          # \x20 and \x09-\x0D, the white space of every word rule here
WS_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared ``spark.checkpoint.dir`` and read back (lineage is cut)."""
    ensure_checkpoint_dir(df.sparkSession)
    return cut_lineage(df)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Within it, Spark removes the shuffle files of each write when the write is done, instead of some time after the driver has
    forgotten it. For frames that are written once, and read from what was written."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_of(spark: SparkSession, size: str):
    """Within it, a batch that Spark hands to Python holds about ``size`` (as "2m"), or a row, instead of 10,000 rows of any size.
    For frames that are written within it."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` on the way to a result. Each is removed once nothing reads it any more;
    those that the lazy result still reads stay."""

    def __init__(self):
        self.folders: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        out, folder = write_and_read(df)
        if folder:
            self.folders[id(out)] = (out, folder)
        return out

    def remove(self, *tables: DataFrame) -> None:
        for t in tables:
            kept = self.folders.pop(id(t), None)
            if kept:
                remove_folder(t.sparkSession, kept[1])

    def remove_but(self, *tables: DataFrame) -> None:
        self.remove(*(t for t, _ in list(self.folders.values()) if all(t is not x for x in tables)))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank text has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
