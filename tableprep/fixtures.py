"""Derived test tables (see FIXTURES.md): the same SQL text runs in Spark and in DuckDB.

Spark receives the base tables as DataFrame arguments of ``spark.sql`` (no global views);
DuckDB gets the text with plain table names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FIXTURE_SQL = {
    # masking and detection: gaps in phone and email
    "customer_pii": """
SELECT c_custkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('13', lpad(CAST((c_custkey * 7919) % 1000000000 AS VARCHAR(20)), 9, '0')) END AS phone,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
  concat('11010119900101', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')) AS id_card,
  concat(substr('张李王刘陈杨赵黄周吴', CAST(c_custkey % 10 AS INT) + 1, 1),
         substr('伟芳娜敏静丽强磊军洋', CAST((c_custkey * 3) % 10 AS INT) + 1, 1)) AS real_name,
  concat('北京市朝阳区建国路', CAST(c_custkey AS VARCHAR(20)), '号') AS address, c_mktsegment, c_acctbal
FROM {customer}""",
    # validation, fills, dropping sparse and empty columns
    "orders_gaps": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 20 = 0 THEN o_orderstatus END AS mostly_missing,
  CAST(NULL AS VARCHAR(10)) AS all_missing,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate
FROM {orders}""",
    # type inference on text
    "events_text": """
SELECT event_id, CAST(user_id AS VARCHAR(20)) AS user_text,
  CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR(30)) END AS value_text,
  concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS VARCHAR(20)), 2, '0')) AS day_text,
  CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS flag_text, event_type
FROM {events}""",
}

FIXTURE_BASE = {"customer_pii": "customer", "orders_gaps": "orders", "events_text": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a Spark DataFrame (lazy; reads the base parquet table)."""
    base = FIXTURE_BASE[name]
    return spark.sql(FIXTURE_SQL[name], **{base: table(spark, sf_dir, base)})


def fixture_sql(name: str) -> str:
    """The derived table's SQL for DuckDB (plain table names)."""
    base = FIXTURE_BASE[name]
    return FIXTURE_SQL[name].replace("{" + base + "}", base)


def with_fixtures(body: str, *names: str, ctes: tuple = ()) -> str:
    """Prefix DuckDB SQL with CTEs for the derived tables it uses, then any extra ``(name, sql)`` CTEs."""
    parts = [f"{n} AS ({fixture_sql(n).strip()})" for n in names] + [f"{a} AS ({b})" for a, b in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
