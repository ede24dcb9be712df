"""Corpus pipeline: raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between two stages the rows are
written as Parquet below ``spark.checkpoint.dir`` and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import decontaminate, near_dedup, packing, quality_rules, secrets
from tableprep.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted again where a stage changes texts."""
    return df.select(*COLUMNS).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rejected documents go; lines above the limits are taken out of the others."""
    return _documents(quality_rules.kept_documents(docs.select(*COLUMNS), quality_rules.HOSTS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component of near copies (five words, similarity 0.8) the smallest id stays."""
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a passage of a benchmark item go."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets, also those in nested encodings, are replaced; every document stays."""
    return _documents(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sequences of at most 1024 tokens; a row for each piece, with its token ids."""
    return packing.pack(docs.select(*COLUMNS), packing.default_path())


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", pack)]

ORACLE_SQL = None      # signatures, decoding and byte-pair ids aren't SQL; tests/llm/test_pipeline_corpus.py has the check


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
