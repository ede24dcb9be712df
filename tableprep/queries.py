"""Query registry: one Spark query per operator of SURVEY §2 and its DuckDB oracle SQL.

Every query reads the generated tables (or the derived fixtures of ``fixtures.py``) in full.
Keys are the names listed in SURVEY §2; ``__spark_entry__.py`` exposes them.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlgen as S
from .fixtures import fixture, table, with_fixtures
from .functions import features as fx
from .functions import masks as M
from .functions import predicates as P
from .functions.columns import as_text, col, number_to_text, to_boolean, to_datetime, to_number
from .operators import impute as I
from .operators.features import FeatureOptions, extract_features
from .operators.masking import MaskSpec, mask_columns, mask_preview, mask_summary
from .operators.ordered_fill import ordered_fill
from .operators.profile import profile
from .operators.quality import data_size, text_checks
from .operators.quantile import exact_medians
from .operators.sample import first_values
from .operators.sensitive import detect_sensitive, mask_decision
from .operators.standardize import (
    apply_type_mapping,
    convert_types,
    distinct_counts,
    drop_duplicate_columns,
    drop_empty_columns,
    infer_types,
    rename_columns,
)
from .operators.validate import basic_stats, preview, preview_counts, validate
from .plans.options import PrepOptions
from .session import ensure_checkpoint_dir
from .sources.io import NA_TOKENS, normalize_na, read_csv, read_json, read_table, write_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def fxt(spark, sf, name):
    return fixture(spark, sf, name)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    base = base[len("file:"):] if base.startswith("file:") else base
    return os.path.join(base, f"{tag}-{uuid.uuid4().hex}")


PII = "customer_pii"
GAPS = "orders_gaps"
EVT = "events_text"
PII_TEXT = ["phone", "email", "id_card", "real_name", "address", "c_mktsegment"]
PII_COLS = ["c_custkey", "phone", "email", "id_card", "real_name", "address", "c_mktsegment", "c_acctbal"]
DETECTED = {"phone": "phone", "email": "email", "id_card": "id_card", "real_name": "name"}

# ------------------------------------------------------------------------------------------------
# 2.1 sources and sinks
# ------------------------------------------------------------------------------------------------

CUST_TYPED_SQL = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
                  "FROM customer")


@query("read_csv", CUST_TYPED_SQL)
def q_read_csv(spark, sf):
    path = scratch(spark, "csv")
    write_table(table(spark, sf, "customer"), path, "csv")
    df = read_csv(spark, path)
    return convert_types(df, infer_types(df, "c_custkey", categorical=False))[0]


@query("read_json", CUST_TYPED_SQL)
def q_read_json(spark, sf):
    path = scratch(spark, "json")
    write_table(table(spark, sf, "customer"), path, "json")
    return read_json(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("normalize_na", with_fixtures(
    "SELECT event_id, " + ", ".join(
        f"CASE WHEN {c} IN ({', '.join(S.lit(t) for t in NA_TOKENS)}) THEN NULL ELSE {c} END AS {c}"
        for c in ["user_text", "value_text", "day_text", "flag_text", "event_type"]) + " FROM events_text", EVT))
def q_normalize_na(spark, sf):
    return normalize_na(fxt(spark, sf, EVT))


PII_AS_TEXT_SQL = with_fixtures(
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, phone, email, id_card, real_name, address, c_mktsegment, "
    "CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer_pii", PII)


@query("write_csv", PII_AS_TEXT_SQL)
def q_write_csv(spark, sf):
    path = scratch(spark, "wcsv")
    write_table(fxt(spark, sf, PII), path, "csv")
    return read_csv(spark, path)


@query("write_json", with_fixtures(
    "SELECT c_custkey, phone, email, id_card, real_name, address, c_mktsegment, c_acctbal FROM customer_pii", PII))
def q_write_json(spark, sf):
    path = scratch(spark, "wjson")
    write_table(fxt(spark, sf, PII), path, "json")
    return read_table(spark, path, "json").select(*PII_COLS)


@query("read_table", "SELECT * FROM customer")
def q_read_table(spark, sf):
    path = scratch(spark, "parquet")
    write_table(table(spark, sf, "customer"), path, "parquet")
    return read_table(spark, path)          # format found from the folder's part files


# ------------------------------------------------------------------------------------------------
# 2.2 validation
# ------------------------------------------------------------------------------------------------

GAPS_COLS = ["o_orderkey", "o_totalprice", "o_orderpriority", "mostly_missing", "all_missing", "o_orderdate"]
_gaps_missing = " + ".join(f"count(*) - count({c})" for c in GAPS_COLS)


@query("basic_stats", with_fixtures(
    f"SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST({_gaps_missing} AS BIGINT) AS missing_cells, "
    f"({_gaps_missing}) / (count(*) * 6.0)::DOUBLE AS missing_rate FROM orders_gaps", GAPS))
def q_basic_stats(spark, sf):
    return basic_stats(fxt(spark, sf, GAPS))


@query("missing_rate", with_fixtures(
    f"SELECT CAST({_gaps_missing} AS BIGINT) AS missing_cells, count(*) * 6 AS cells, "
    f"({_gaps_missing}) / (count(*) * 6.0)::DOUBLE AS missing_rate, ({_gaps_missing}) / (count(*) * 6.0)::DOUBLE > 0.8 AS too_sparse "
    f"FROM orders_gaps", GAPS))
def q_missing_rate(spark, sf):
    v = validate(fxt(spark, sf, GAPS))
    p = v.prof
    return spark.createDataFrame([(p.total_missing, p.cells, p.missing_rate, any(e[0] == "missing_rate" for e in v.errors))],
                                 "missing_cells bigint, cells bigint, missing_rate double, too_sparse boolean")


def _validate_sql(part, where):
    return (f"SELECT '{part}' AS part, count(*) AS rows, CAST(6 AS BIGINT) AS columns, count(*) = 0 AS is_empty, count(*) > 10000 AS over_row_limit, "
            f"coalesce(({_gaps_missing}) / nullif(count(*) * 6.0, 0) > 0.3, false) AS over_missing_limit, "
            f"count(*) BETWEEN 1 AND 10000 AND ({_gaps_missing}) / nullif(count(*) * 6.0, 0) <= 0.3 AS valid FROM orders_gaps WHERE {where}")


VALIDATED = {"all": "true", "none": "o_orderkey < 0", "some": "o_orderkey % 20 = 0 AND o_orderkey % 7 <> 0"}


@query("validate_table", with_fixtures(" UNION ALL ".join(_validate_sql(p, w) for p, w in VALIDATED.items()), GAPS))
def q_validate_table(spark, sf):
    """V1, V2, V6 by ``validate``: the whole table, no row of it, and a part without many gaps."""
    rows = []
    for part, where in VALIDATED.items():
        v = validate(fxt(spark, sf, GAPS).where(where), max_rows=10_000, max_missing_rate=0.3)
        codes = {e[0] for e in v.errors}
        rows.append((part, v.stats["rows"], v.stats["columns"], "empty_table" in codes, "too_many_rows" in codes, "missing_rate" in codes, v.valid))
    return spark.createDataFrame(rows, "part string, rows bigint, columns bigint, is_empty boolean, over_row_limit boolean, "
                                       "over_missing_limit boolean, valid boolean")


_empty_cols_sql = " UNION ALL ".join(f"SELECT {S.lit(c)} AS column, count({c}) AS n FROM orders_gaps" for c in GAPS_COLS)


@query("empty_columns", with_fixtures(f"SELECT column FROM ({_empty_cols_sql}) t WHERE n = 0", GAPS))
def q_empty_columns(spark, sf):
    p = profile(fxt(spark, sf, GAPS))
    return spark.createDataFrame([(c,) for c in p.empty_columns()], "column string")


@query("validate_only", with_fixtures(
    f"SELECT 'warning' AS level, 'empty_column' AS code, column AS subject FROM ({_empty_cols_sql}) t WHERE n = 0 "
    f"UNION ALL SELECT 'error', 'missing_rate', '' FROM orders_gaps HAVING ({_gaps_missing}) / (count(*) * 6.0) > 0.8", GAPS))
def q_validate_only(spark, sf):
    v = validate(fxt(spark, sf, GAPS), max_rows=None)
    return v.report(spark).where("level <> 'stat'").select("level", "code", "subject")


@query("validation_gate", with_fixtures(
    f"SELECT count(*) <= 10000 AND ({_gaps_missing}) / (count(*) * 6.0) <= 0.8 AS valid, "
    f"CAST(count(*) > 10000 AS BIGINT) + CAST(({_gaps_missing}) / (count(*) * 6.0) > 0.8 AS BIGINT) AS n_errors "
    f"FROM orders_gaps", GAPS))
def q_validation_gate(spark, sf):
    v = validate(fxt(spark, sf, GAPS), max_rows=10000)
    return spark.createDataFrame([(v.valid, len(v.errors))], "valid boolean, n_errors bigint")


@query("preview", with_fixtures("SELECT * FROM orders_gaps ORDER BY o_orderkey LIMIT 10", GAPS))
def q_preview(spark, sf):
    return preview(fxt(spark, sf, GAPS), "o_orderkey", 10)


# ------------------------------------------------------------------------------------------------
# 2.3 names
# ------------------------------------------------------------------------------------------------

ODD_NAMES = ["EventID", "Event Time", "user-id", "eventType", "Value (USD)", "属性 Props"]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _odd_events(spark, sf):
    return table(spark, sf, "events").select(*EVENT_COLS).toDF(*ODD_NAMES)


def _renamed_sql(names):
    return "SELECT " + ", ".join(f'{c} AS "{n}"' for c, n in zip(EVENT_COLS, names)) + " FROM events"


@query("rename_snake", _renamed_sql(["event_id", "event_time", "userid", "event_type", "value_usd", "属性_props"]))
def q_rename_snake(spark, sf):
    return rename_columns(_odd_events(spark, sf), "snake_case")[0]


@query("rename_camel", _renamed_sql(["eventId", "eventTime", "userid", "eventType", "valueUsd", "属性Props"]))
def q_rename_camel(spark, sf):
    return rename_columns(_odd_events(spark, sf), "camelCase")[0]


@query("rename_pascal", _renamed_sql(["EventId", "EventTime", "Userid", "EventType", "ValueUsd", "属性Props"]))
def q_rename_pascal(spark, sf):
    return rename_columns(_odd_events(spark, sf), "PascalCase")[0]


@query("rename_columns", 'SELECT c_custkey AS "c_custkey", c_name AS "user_name", c_mktsegment AS "user_name_2", '
                         'c_acctbal AS "acct_bal" FROM customer')
def q_rename_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal") \
        .toDF("c_custkey", "User Name", "user_name", "AcctBal")
    return rename_columns(df, "snake_case")[0]


@query("drop_dup_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_drop_dup_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal") \
        .toDF("c_custkey", "c_name", "c_name", "c_acctbal")
    return drop_duplicate_columns(df)


@query("drop_empty_columns", with_fixtures(
    "SELECT o_orderkey, o_totalprice, o_orderpriority, mostly_missing, o_orderdate FROM orders_gaps", GAPS))
def q_drop_empty_columns(spark, sf):
    return drop_empty_columns(fxt(spark, sf, GAPS))[0]


# ------------------------------------------------------------------------------------------------
# 2.4 type inference and casts (events_text)
# ------------------------------------------------------------------------------------------------

EVT_TEXT = ["user_text", "value_text", "day_text", "flag_text", "event_type"]
BOOL_PAIRS_SQL = ["('true','false')", "('yes','no')", "('y','n')", "('1','0')", "('是','否')"]


def _bool_sql(c):
    return "(" + " OR ".join(f"coalesce(bool_and(lower({c}) IN {p}), false)" for p in BOOL_PAIRS_SQL) + ")"


def _num_sql(c):
    return f"(count(*) FILTER (WHERE {c} IS NOT NULL AND NOT {S.blank(c)} AND NOT regexp_full_match({c}, '{S.NUMBER_RE}')) = 0)"


def _dt_first10_sql(src, c, fmt_sql="%Y-%m-%d"):
    return (f"(SELECT bool_and(try_strptime({c}, '{fmt_sql}') IS NOT NULL) FROM (SELECT {c} FROM {src} "
            f"WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 10) s)")


@query("infer_boolean", with_fixtures(
    " UNION ALL ".join(f"SELECT {S.lit(c)} AS column, {_bool_sql(c)} AS is_boolean FROM events_text" for c in EVT_TEXT), EVT))
def q_infer_boolean(spark, sf):
    p = profile(fxt(spark, sf, EVT).select(*EVT_TEXT), text_evidence=True)
    rows = [(c, any(p.stats[c].get(f"bool_{i}") == 1 for i in range(5))) for c in EVT_TEXT]
    return spark.createDataFrame(rows, "column string, is_boolean boolean")


@query("infer_numeric", with_fixtures(
    " UNION ALL ".join(f"SELECT {S.lit(c)} AS column, {_num_sql(c)} AS is_numeric FROM events_text" for c in EVT_TEXT), EVT))
def q_infer_numeric(spark, sf):
    p = profile(fxt(spark, sf, EVT).select(*EVT_TEXT), text_evidence=True)
    return spark.createDataFrame([(c, p.stats[c]["bad_number"] == 0) for c in EVT_TEXT], "column string, is_numeric boolean")


@query("infer_datetime", with_fixtures(
    " UNION ALL ".join(f"SELECT {S.lit(c)} AS column, CASE WHEN {_dt_first10_sql('events_text', c)} THEN 'yyyy-M-d' END AS fmt"
                       for c in ["value_text", "day_text", "event_type"]), EVT))
def q_infer_datetime(spark, sf):
    from .operators.standardize import _datetime_formats

    cols = ["value_text", "day_text", "event_type"]
    f = _datetime_formats(fxt(spark, sf, EVT), cols, "event_id")
    return spark.createDataFrame([(c, f.get(c)) for c in cols], "column string, fmt string")


def _cat_sql(c):
    return f"(count(DISTINCT {c}) / count({c}) < 0.1 AND count(DISTINCT {c}) < 50)"


CATEGORIES = {"event_type": "event_type", "c49": "'v' || event_id % 49", "c50": "'v' || event_id % 50", "c51": "'v' || event_id % 51",
              "many": "'v' || event_id", "rare": "CASE WHEN event_id % 500 = 0 THEN 'v' || event_id % 1500 END"}


@query("infer_categorical", with_fixtures(" UNION ALL ".join(
    f"SELECT {S.lit(c)} AS column, {_cat_sql(e)} AS is_categorical FROM events_text" for c, e in CATEGORIES.items()), EVT))
def q_infer_categorical(spark, sf):
    """S10 by ``infer_types``, on both sides of its two limits."""
    df = fxt(spark, sf, EVT).selectExpr("event_id", *(f"{e} AS {c}" for c, e in CATEGORIES.items()))
    rows = [(d.column, d.detected == "categorical") for d in infer_types(df, "event_id") if d.column in CATEGORIES]
    return spark.createDataFrame(rows, "column string, is_categorical boolean")


def _infer_types_sql():
    rows = ["SELECT 'event_id' AS column, 'numeric' AS detected FROM events_text LIMIT 1"]
    for c in EVT_TEXT:
        rows.append(
            f"SELECT {S.lit(c)}, CASE WHEN count({c}) = 0 THEN 'text' WHEN {_bool_sql(c)} THEN 'boolean' "
            f"WHEN {_num_sql(c)} THEN 'numeric' WHEN {_dt_first10_sql('events_text', c)} THEN 'datetime' "
            f"WHEN {_cat_sql(c)} THEN 'categorical' ELSE 'text' END FROM events_text")
    return with_fixtures(" UNION ALL ".join(f"({r})" for r in rows), EVT)


@query("infer_types", _infer_types_sql())
def q_infer_types(spark, sf):
    d = infer_types(fxt(spark, sf, EVT), "event_id")
    return spark.createDataFrame([(x.column, x.detected) for x in d], "column string, detected string")


AUTO_BODY = ("SELECT event_id, CAST(user_text AS BIGINT) AS user_text, TRY_CAST(value_text AS DOUBLE) AS value_text, "
             "strptime(day_text, '%Y-%m-%d') AS day_text, flag_text, event_type FROM events_text")
AUTO_SQL = with_fixtures(AUTO_BODY, EVT)


@query("auto_convert", AUTO_SQL)
def q_auto_convert(spark, sf):
    df = normalize_na(fxt(spark, sf, EVT))
    # conversion depends on the boolean / numeric / datetime tests only; the categorical test is not needed
    return convert_types(df, infer_types(df, "event_id", categorical=False))[0]


@query("cast_numeric", with_fixtures("SELECT event_id, TRY_CAST(value_text AS DOUBLE) AS value_num, "
                                     "CAST(user_text AS BIGINT) AS user_num FROM events_text", EVT))
def q_cast_numeric(spark, sf):
    df = fxt(spark, sf, EVT)
    return df.select("event_id", to_number(col("value_text"), False).alias("value_num"),
                     to_number(col("user_text"), True).alias("user_num"))


@query("cast_datetime", with_fixtures("SELECT event_id, try_strptime(day_text, '%Y-%m-%d') AS day_ts, "
                                      "try_strptime(value_text, '%Y-%m-%d') AS bad_ts FROM events_text", EVT))
def q_cast_datetime(spark, sf):
    df = fxt(spark, sf, EVT)
    return df.select("event_id", to_datetime(col("day_text"), "yyyy-M-d").alias("day_ts"),
                     to_datetime(col("value_text"), "yyyy-M-d").alias("bad_ts"))


@query("cast_boolean", with_fixtures(
    "SELECT event_id, CASE lower(flag_text) WHEN 'yes' THEN true WHEN 'no' THEN false END AS flag, "
    "CASE lower(event_type) WHEN 'yes' THEN true WHEN 'no' THEN false END AS not_flag FROM events_text", EVT))
def q_cast_boolean(spark, sf):
    df = fxt(spark, sf, EVT)
    return df.select("event_id", to_boolean(col("flag_text")).alias("flag"), to_boolean(col("event_type")).alias("not_flag"))


@query("cast_categorical", with_fixtures("SELECT event_id, event_type FROM events_text", EVT))
def q_cast_categorical(spark, sf):
    df = fxt(spark, sf, EVT).select("event_id", "event_type")
    return apply_type_mapping(df, {"event_type": "categorical"})[0]


@query("cast_text", "SELECT event_id, CAST(value AS VARCHAR) AS value_text, CAST(user_id AS VARCHAR) AS user_text FROM events")
def q_cast_text(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", as_text(col("value"), df.schema["value"].dataType).alias("value_text"),
                     col("user_id").cast("string").alias("user_text"))


@query("custom_types", with_fixtures(
    "SELECT event_id, CAST(user_text AS BIGINT) AS user_text, value_text, strptime(day_text, '%Y-%m-%d') AS day_text, "
    "CASE lower(flag_text) WHEN 'yes' THEN true WHEN 'no' THEN false END AS flag_text, event_type FROM events_text", EVT))
def q_custom_types(spark, sf):
    df = fxt(spark, sf, EVT)
    m = {"user_text": "numeric", "day_text": "datetime", "flag_text": "boolean", "event_type": "categorical",
         "not_a_column": "text"}
    return apply_type_mapping(df, m, order_by="event_id")[0]


@query("type_changes", with_fixtures(
    " UNION ALL ".join(
        f"SELECT {S.lit(c)} AS column, 'string' AS from_type, CASE WHEN {_num_sql(c)} THEN "
        f"CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_full_match({c}, '\\s*[+-]?[0-9]+\\s*')) = 0 "
        f"THEN 'bigint' ELSE 'double' END WHEN {_dt_first10_sql('t', c)} THEN 'timestamp_ntz' END AS to_type FROM t"
        for c in ["user_text", "value_text", "day_text"]),
    EVT, ctes=(("t", "SELECT event_id, user_text, NULLIF(value_text, 'n/a') AS value_text, day_text FROM events_text"),)))
def q_type_changes(spark, sf):
    df = normalize_na(fxt(spark, sf, EVT))
    ch = convert_types(df, infer_types(df, "event_id"))[1]
    return spark.createDataFrame([(c, a, b) for c, (a, b) in ch.items()], "column string, from_type string, to_type string")


# ------------------------------------------------------------------------------------------------
# 2.5 missing values (orders_gaps)
# ------------------------------------------------------------------------------------------------

KEPT = "o_orderkey, o_totalprice, o_orderpriority, o_orderdate"


def _fill(spark, sf, **kw) -> DataFrame:
    df = fxt(spark, sf, GAPS)
    out, _ = I.fill_missing(df, I.FillOptions(**kw), order_by="o_orderkey")
    return out


def _r6(df: DataFrame, c: str) -> DataFrame:
    """Round a filled double to 6 places: sums of doubles differ in the last bits between engines."""
    return df.withColumn(c, F.round(col(c), 6))


@query("drop_sparse_columns", with_fixtures(f"SELECT {KEPT} FROM orders_gaps", GAPS))
def q_drop_sparse_columns(spark, sf):
    return _fill(spark, sf, default_strategy="custom")


@query("fill_constant", with_fixtures(
    "SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority, "
    "o_orderdate FROM orders_gaps", GAPS))
def q_fill_constant(spark, sf):
    return _fill(spark, sf, default_strategy="custom",
                 custom_fill_values={"o_totalprice": 0.0, "o_orderpriority": "UNKNOWN"})


@query("fill_mean", with_fixtures(
    "SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_gaps)), 6) AS o_totalprice, "
    "o_orderpriority, o_orderdate FROM orders_gaps", GAPS))
def q_fill_mean(spark, sf):
    return _r6(_fill(spark, sf, default_strategy="mean"), "o_totalprice")


@query("fill_median", with_fixtures(
    "SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_gaps)), 6) AS o_totalprice, "
    "o_orderpriority, o_orderdate FROM orders_gaps", GAPS))
def q_fill_median(spark, sf):
    return _r6(_fill(spark, sf, default_strategy="median"), "o_totalprice")


def _mode_sql(c, src="orders_gaps"):
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("fill_mode", with_fixtures(
    f"SELECT o_orderkey, coalesce(o_totalprice, {_mode_sql('o_totalprice')}) AS o_totalprice, "
    f"coalesce(o_orderpriority, {_mode_sql('o_orderpriority')}) AS o_orderpriority, "
    f"coalesce(o_orderdate, {_mode_sql('o_orderdate')}) AS o_orderdate FROM orders_gaps", GAPS))
def q_fill_mode(spark, sf):
    return _fill(spark, sf, default_strategy="mode")


def _ordered_sql(fn, frame, cols):
    parts = [f"{fn}({c} IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN {frame}) AS {c}" for c in cols]
    return "SELECT o_orderkey, " + ", ".join(parts)


FILL_COLS = ["o_totalprice", "o_orderpriority", "o_orderdate"]


@query("fill_forward", with_fixtures(
    _ordered_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", FILL_COLS) + " FROM orders_gaps", GAPS))
def q_fill_forward(spark, sf):
    return _fill(spark, sf, default_strategy="forward_fill")


@query("fill_backward", with_fixtures(
    _ordered_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING", FILL_COLS) + " FROM orders_gaps", GAPS))
def q_fill_backward(spark, sf):
    return _fill(spark, sf, default_strategy="backward_fill")


@query("drop_missing_rows", with_fixtures(f"SELECT {KEPT} FROM orders_gaps WHERE o_orderpriority IS NOT NULL", GAPS))
def q_drop_missing_rows(spark, sf):
    return _fill(spark, sf, default_strategy="custom", column_strategies={"o_orderpriority": "drop"})


@query("fill_mixed", with_fixtures(
    "SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_gaps)), 6) AS o_totalprice, "
    f"coalesce(o_orderpriority, 'NONE') AS o_orderpriority, "
    "last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_orderdate "
    "FROM orders_gaps", GAPS))
def q_fill_mixed(spark, sf):
    out = _fill(spark, sf, default_strategy="mean",
                column_strategies={"o_totalprice": "median", "o_orderpriority": "mode", "o_orderdate": "forward_fill"},
                custom_fill_values={"o_orderpriority": "NONE"})
    return _r6(out, "o_totalprice")


@query("fill_after_drop", with_fixtures(
    "SELECT o_orderkey, o_orderpriority, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM f)), 6) AS o_totalprice, "
    "last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_orderdate "
    "FROM f", GAPS, ctes=(("f", "SELECT * FROM orders_gaps WHERE o_orderpriority IS NOT NULL"),)))
def q_fill_after_drop(spark, sf):
    df = fxt(spark, sf, GAPS).select("o_orderkey", "o_orderpriority", "o_totalprice", "mostly_missing", "o_orderdate")
    out, _ = I.fill_missing(df, I.FillOptions(default_strategy="mean", column_strategies={
        "o_orderpriority": "drop", "o_orderdate": "forward_fill"}), order_by="o_orderkey")
    return _r6(out, "o_totalprice")


@query("missing_reduction", with_fixtures(
    f"SELECT CAST({_gaps_missing} AS BIGINT) AS missing_before, "
    f"CAST((count(*) - count(o_orderpriority)) + (count(*) - count(o_orderdate)) AS BIGINT) AS missing_after, "
    f"CAST({_gaps_missing} - (count(*) - count(o_orderpriority)) - (count(*) - count(o_orderdate)) AS BIGINT) AS missing_reduction "
    f"FROM orders_gaps", GAPS))
def q_missing_reduction(spark, sf):
    df = fxt(spark, sf, GAPS)
    out, plan = I.fill_missing(df, I.FillOptions())
    less = I.missing_reduction(plan, out)
    return spark.createDataFrame([(plan.missing_before, plan.missing_before - less, less)],
                                 "missing_before bigint, missing_after bigint, missing_reduction bigint")


# ------------------------------------------------------------------------------------------------
# 2.6 detection (customer_pii)
# ------------------------------------------------------------------------------------------------

def _pii_text_cols():
    return [("c_custkey", "CAST(c_custkey AS VARCHAR)")] + [(c, c) for c in PII_TEXT] + [("c_acctbal", "CAST(c_acctbal AS VARCHAR)")]


SAMPLE_SQL = S.first_values("customer_pii", "c_custkey", _pii_text_cols(), 20)


@query("sample_values", with_fixtures(SAMPLE_SQL, PII))
def q_sample_values(spark, sf):
    return first_values(fxt(spark, sf, PII), PII_COLS, "c_custkey", 20)


def _rates_sql():
    rates = ", ".join(f"avg(CAST({S.PREDICATES[t]('value')} AS DOUBLE)) AS {t}_rate" for t in P.SENSITIVE_TYPES)
    return f"SELECT column, count(*) AS n_samples, {rates} FROM ({SAMPLE_SQL}) s GROUP BY column"


def _name_type_sql(c):
    for t in P.SENSITIVE_TYPES:
        if any(k in c.lower() for k in P.NAME_KEYWORDS[t]):
            return t
    return "none"


def _name_sql():
    # the keyword match itself is checked in SQL with LIKE against the fixed keyword lists
    parts = []
    for i, c in enumerate(PII_COLS):
        e = "'none'"
        for t in reversed(P.SENSITIVE_TYPES):
            cond = " OR ".join(f"lower({S.lit(c)}) LIKE {S.lit('%' + k + '%')}" for k in P.NAME_KEYWORDS[t])
            e = f"CASE WHEN {cond} THEN '{t}' ELSE {e} END"
        parts.append(f"SELECT {i} AS position, {S.lit(c)} AS column, {e} AS name_type")
    return " UNION ALL ".join(parts)


def _detect_sql():
    confirm = "CASE " + " ".join(f"WHEN name_type = '{t}' THEN {t}_rate >= 0.5" for t in P.SENSITIVE_TYPES) + " ELSE false END"
    by_value = ("CASE " + " ".join(f"WHEN {t}_rate > 0.7 THEN '{t}'" for t in ("phone", "id_card", "email", "name"))
                + " ELSE 'none' END")
    det = f"CASE WHEN n_samples IS NULL THEN NULL WHEN name_type <> 'none' AND {confirm} THEN name_type ELSE {by_value} END"
    score = ("CASE d " + " ".join(f"WHEN '{t}' THEN CAST({P.SCORES[t]} AS DOUBLE)" for t in P.SENSITIVE_TYPES)
             + " WHEN 'none' THEN CAST(0.0 AS DOUBLE) END")
    return (f"SELECT position, column, name_type, n_samples, {', '.join(t + '_rate' for t in P.SENSITIVE_TYPES)}, "
            f"d AS detected_type, {score} AS score, {confirm} AS confirmed, {by_value} AS value_type FROM "
            f"(SELECT *, {det} AS d FROM ({_name_sql()}) n LEFT JOIN ({_rates_sql()}) r USING (column)) j")


DETECT_SQL = _detect_sql()


def _detect(spark, sf):
    return detect_sensitive(fxt(spark, sf, PII), "c_custkey")


@query("detect_sensitive", with_fixtures(
    f"SELECT position, column, name_type, CAST(n_samples AS BIGINT) AS n_samples, phone_rate, id_card_rate, email_rate, "
    f"name_rate, address_rate, detected_type, score FROM ({DETECT_SQL}) x", PII))
def q_detect_sensitive(spark, sf):
    return _detect(spark, sf).drop("confirmed", "value_type")


@query("sensitivity_score", with_fixtures(f"SELECT column, score FROM ({DETECT_SQL}) x", PII))
def q_sensitivity_score(spark, sf):
    return _detect(spark, sf).select("column", "score")


@query("confirm_type", with_fixtures(f"SELECT column, name_type, confirmed FROM ({DETECT_SQL}) x", PII))
def q_confirm_type(spark, sf):
    return _detect(spark, sf).select("column", "name_type", "confirmed")


@query("detect_by_values", with_fixtures(f"SELECT column, value_type FROM ({DETECT_SQL}) x", PII))
def q_detect_by_values(spark, sf):
    return _detect(spark, sf).select("column", "value_type")


def _decision_sql(threshold=0.7, verdict_cols=(), rules=None):
    rules = rules or {}
    rule_t = "CASE column " + " ".join(f"WHEN {S.lit(c)} THEN {S.lit(r.get('type', 'text'))}" for c, r in rules.items()) + " END" \
        if rules else "NULL"
    rule_s = "CASE column " + " ".join(f"WHEN {S.lit(c)} THEN {S.lit(r.get('strategy', 'partial'))}" for c, r in rules.items()) + " END" \
        if rules else "NULL"
    verdict = "(" + " OR ".join(f"column = {S.lit(c)}" for c in verdict_cols) + ")" if verdict_cols else "false"
    auto = f"(n_samples > 0 AND (score >= {threshold} OR {verdict}))"
    return (f"SELECT position, column, ({rule_t} IS NOT NULL OR coalesce({auto}, false)) AS should_mask, "
            f"CASE WHEN {rule_t} IS NOT NULL THEN {rule_t} WHEN {auto} THEN CASE WHEN detected_type <> 'none' THEN detected_type "
            f"ELSE 'text' END END AS masking_type, "
            f"CASE WHEN {rule_t} IS NOT NULL THEN {rule_s} WHEN {auto} THEN 'partial' END AS strategy "
            f"FROM ({DETECT_SQL}) x")


@query("mask_decision", with_fixtures(_decision_sql(), PII))
def q_mask_decision(spark, sf):
    return mask_decision(_detect(spark, sf)).select("position", "column", "should_mask", "masking_type", "strategy")


@query("external_verdicts", with_fixtures(_decision_sql(verdict_cols=("c_mktsegment",)), PII))
def q_external_verdicts(spark, sf):
    verdicts = spark.createDataFrame([("c_mktsegment", True, "text"), ("address", False, "address")],
                                     "column string, is_sensitive boolean, suggested_type string")
    return mask_decision(_detect(spark, sf), verdicts=verdicts).select(
        "position", "column", "should_mask", "masking_type", "strategy")


RULES = {"address": {"type": "address"}, "c_mktsegment": {"strategy": "hash"}}


@query("column_rules", with_fixtures(_decision_sql(rules=RULES), PII))
def q_column_rules(spark, sf):
    return mask_decision(_detect(spark, sf), column_rules=RULES).select(
        "position", "column", "should_mask", "masking_type", "strategy")


def _pred_query(name, pred, cols):
    sql = with_fixtures("SELECT c_custkey, " + ", ".join(f"{S.PREDICATES[pred](c)} AS {c}_{pred}" for c in cols)
                        + " FROM customer_pii", PII)

    @query(name, sql)
    def fn(spark, sf):
        d = fxt(spark, sf, PII)
        return d.select("c_custkey", *[P.PREDICATES[pred](col(c)).alias(f"{c}_{pred}") for c in cols])
    return fn


_pred_query("is_phone", "phone", ["phone", "id_card", "email"])
_pred_query("is_id_card", "id_card", ["id_card", "phone"])
_pred_query("is_email", "email", ["email", "address"])
_pred_query("is_cn_name", "name", ["real_name", "address"])
_pred_query("is_address", "address", ["address", "real_name"])


@query("number_to_text", "SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS DECIMAL(38,0)) AS VARCHAR) "
                         "ELSE CAST(c_acctbal AS VARCHAR) END AS acctbal_text, "
                         "CAST(CAST(c_custkey * 1000 AS DECIMAL(38,0)) AS VARCHAR) AS whole_text FROM customer")
def q_number_to_text(spark, sf):
    d = table(spark, sf, "customer")
    return d.select("c_custkey", number_to_text(col("c_acctbal")).alias("acctbal_text"),
                    number_to_text((col("c_custkey") * 1000).cast("double")).alias("whole_text"))


# ------------------------------------------------------------------------------------------------
# 2.7 masking (customer_pii)
# ------------------------------------------------------------------------------------------------

def _mask_query(name, kind, column, strategy="partial"):
    if strategy == "hash":
        e = S.mask_hash(column)
    elif strategy == "remove":
        e = S.mask_remove(column)
    else:
        e = S.PARTIAL[kind](column)
    sql = with_fixtures(f"SELECT c_custkey, {column}, {e} AS masked FROM customer_pii", PII)

    @query(name, sql)
    def fn(spark, sf):
        d = fxt(spark, sf, PII)
        return d.select("c_custkey", column, M.mask(col(column), kind, strategy).alias("masked"))
    return fn


_mask_query("mask_phone", "phone", "phone")
_mask_query("mask_id_card", "id_card", "id_card")
_mask_query("mask_email", "email", "email")
_mask_query("mask_name", "name", "real_name")
_mask_query("mask_address", "address", "address")
_mask_query("mask_generic", "text", "c_mktsegment")
_mask_query("mask_hash", "phone", "phone", "hash")
_mask_query("mask_remove", "email", "email", "remove")


def _fmt_query(name, kind, column, pattern_sql_spark, extra=None):
    sql = with_fixtures(f"SELECT count({column}) AS n_values, count({column}) AS n_well_formed FROM customer_pii", PII)

    @query(name, sql)
    def fn(spark, sf):
        d = fxt(spark, sf, PII)
        m = M.mask(col(column), kind, "random", seed=7)
        ok = m.rlike(pattern_sql_spark)
        if extra is not None:
            ok = ok & extra(m, col(column))
        return d.agg(F.count(m).alias("n_values"), F.count(F.when(ok, 1)).alias("n_well_formed"))
    return fn


_fmt_query("random_phone", "phone", "phone", "^(13[0-9]|15[0-35-9]|18[0-9])[0-9]{8}$")
_fmt_query("random_id_card", "id_card", "id_card", "^[0-9]{17}[0-9X]$")
_fmt_query("random_email", "email", "email", "^[a-z]{5,10}@(example\\.com|test\\.com|demo\\.org|sample\\.net)$")
_fmt_query("random_name", "name", "real_name", "^[张李王刘陈杨赵黄周吴][伟芳娜敏静丽强磊军洋]{1,2}$")
_fmt_query("random_text", "address", "address", "^[a-zA-Z0-9]+$", lambda m, v: F.char_length(m) == F.char_length(v))


@query("mask_all_strategies", with_fixtures(
    f"SELECT c_custkey, {S.mask_phone('phone')} AS phone_partial, {S.mask_hash('phone')} AS phone_hash, "
    f"{S.mask_remove('phone')} AS phone_remove, {S.mask_phone('phone')} AS phone_unknown, "
    f"{S.mask_generic('address')} AS address_other FROM customer_pii", PII))
def q_mask_all_strategies(spark, sf):
    d = fxt(spark, sf, PII)
    p = col("phone")
    return d.select("c_custkey", M.mask(p, "phone", "partial").alias("phone_partial"),
                    M.mask(p, "phone", "hash").alias("phone_hash"), M.mask(p, "phone", "remove").alias("phone_remove"),
                    M.mask(p, "phone", "no_such_strategy").alias("phone_unknown"),
                    M.mask(col("address"), "other", "partial").alias("address_other"))


BLANKY = "CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE phone END"


@query("mask_blank_null", with_fixtures(
    f"SELECT c_custkey, {S.mask_phone('b')} AS partial, {S.mask_hash('b')} AS hashed, {S.mask_remove('b')} AS removed "
    f"FROM (SELECT c_custkey, {BLANKY} AS b FROM customer_pii) t", PII))
def q_mask_blank_null(spark, sf):
    d = fxt(spark, sf, PII).select("c_custkey", F.expr(BLANKY).alias("b"))
    b = col("b")
    return d.select("c_custkey", M.mask(b, "phone").alias("partial"), M.mask(b, "phone", "hash").alias("hashed"),
                    M.mask(b, "phone", "remove").alias("removed"))


MASKED_PII_SQL = (f"SELECT c_custkey, {S.mask_phone('phone')} AS phone, {S.mask_email('email')} AS email, "
                  f"{S.mask_id_card('id_card')} AS id_card, {S.mask_name('real_name')} AS real_name, address, c_mktsegment, "
                  f"c_acctbal FROM customer_pii")


@query("mask_columns", with_fixtures(MASKED_PII_SQL, PII))
def q_mask_columns(spark, sf):
    specs = {c: MaskSpec(t) for c, t in DETECTED.items()}
    return mask_columns(fxt(spark, sf, PII), specs)


@query("mask_preview", with_fixtures(
    f"SELECT column, pos, value AS original, CASE column WHEN 'phone' THEN {S.mask_phone('value')} "
    f"ELSE {S.mask_email('value')} END AS masked FROM ({S.first_values('customer_pii', 'c_custkey', [('phone', 'phone'), ('email', 'email')], 5)}) s",
    PII))
def q_mask_preview(spark, sf):
    return mask_preview(fxt(spark, sf, PII), {"phone": MaskSpec("phone"), "email": MaskSpec("email")}, "c_custkey", 5)


def _summary_sql():
    fv = S.first_values("customer_pii", "c_custkey", [(c, c) for c in DETECTED], 3)
    m = "CASE column " + " ".join(f"WHEN {S.lit(c)} THEN {S.PARTIAL[t]('value')}" for c, t in DETECTED.items()) + " END"
    t = "CASE column " + " ".join(f"WHEN {S.lit(c)} THEN {S.lit(k)}" for c, k in DETECTED.items()) + " END"
    return (f"SELECT column, {t} AS masking_type, 'partial' AS strategy, string_agg({m}, '|' ORDER BY pos) AS masked_preview "
            f"FROM ({fv}) s GROUP BY column")


@query("mask_summary", with_fixtures(_summary_sql(), PII))
def q_mask_summary(spark, sf):
    specs = {c: MaskSpec(t) for c, t in DETECTED.items()}
    s = mask_summary(fxt(spark, sf, PII), specs, "c_custkey")
    return s.select("column", "masking_type", "strategy", F.array_join("masked_preview", "|").alias("masked_preview"))


# ------------------------------------------------------------------------------------------------
# 2.8 features
# ------------------------------------------------------------------------------------------------

@query("feat_is_null", with_fixtures("SELECT o_orderkey, CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_is_null FROM orders_gaps", GAPS))
def q_feat_is_null(spark, sf):
    d = fxt(spark, sf, GAPS)
    return d.select("o_orderkey", fx.is_null_flag(col("o_totalprice"), d.schema["o_totalprice"].dataType).alias("o_totalprice_is_null"))


@query("feat_abs", "SELECT c_custkey, abs(c_acctbal) AS c_acctbal_abs FROM customer")
def q_feat_abs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fx.absolute(col("c_acctbal")).alias("c_acctbal_abs"))


@query("feat_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents")
def q_feat_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.text_length(col("text")).alias("text_length"))


@query("feat_word_count", f"SELECT doc_id, {S.word_count('text')} AS text_word_count FROM documents")
def q_feat_word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.word_count(col("text")).alias("text_word_count"))


@query("feat_is_empty", f"SELECT conv_id, turn, {S.is_empty('text')} AS text_is_empty FROM conversations")
def q_feat_is_empty(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", fx.is_empty_flag(col("text")).alias("text_is_empty"))


@query("feat_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year FROM orders")
def q_feat_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.year(col("o_orderdate")).alias("o_orderdate_year"))


@query("feat_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month FROM orders")
def q_feat_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.month(col("o_orderdate")).alias("o_orderdate_month"))


@query("feat_dayofweek", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek FROM orders")
def q_feat_dayofweek(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.day_of_week(col("o_orderdate")).alias("o_orderdate_dayofweek"))


def _gaps_features_sql():
    num = "CAST(o_orderkey IS NULL AS INTEGER) AS o_orderkey_is_null, abs(o_orderkey) AS o_orderkey_abs, " \
          "CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_is_null, abs(o_totalprice) AS o_totalprice_abs"
    txt = ", ".join(f"CAST(length({c}) AS BIGINT) AS {c}_length, {S.word_count(c)} AS {c}_word_count, {S.is_empty(c)} AS {c}_is_empty"
                    for c in ("o_orderpriority", "mostly_missing"))
    dt = ("CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
          "CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek")
    return with_fixtures(f"SELECT *, {num}, {txt}, {dt} FROM orders_gaps", GAPS)


@query("extract_features", _gaps_features_sql())
def q_extract_features(spark, sf):
    return extract_features(fxt(spark, sf, GAPS))[0]


# ------------------------------------------------------------------------------------------------
# 2.9 quality report: orders_gaps before vs. the default fill after it
# ------------------------------------------------------------------------------------------------

AFTER_SQL = ("SELECT o_orderkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_gaps)) AS o_totalprice, "
             "o_orderpriority, o_orderdate FROM orders_gaps")
AFTER_COLS = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate"]


def _with_after(body: str) -> str:
    return with_fixtures(body, GAPS, ctes=(("after_t", AFTER_SQL),))


def _pair(spark, sf):
    before = fxt(spark, sf, GAPS)
    after, _ = I.fill_missing(before, I.FillOptions())
    return before, after


def _missing_sum(cols, t):
    return " + ".join(f"(SELECT count(*) - count({c}) FROM {t})" for c in cols)


@query("quality_basic", _with_after(
    "SELECT 'original' AS side, count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM orders_gaps "
    "UNION ALL SELECT 'processed', count(*), CAST(4 AS BIGINT) FROM after_t"))
def q_quality_basic(spark, sf):
    b, a = _pair(spark, sf)
    pb, pa = profile(b), profile(a)
    return spark.createDataFrame([("original", pb.rows, pb.n_columns), ("processed", pa.rows, pa.n_columns)],
                                 "side string, rows bigint, columns bigint")


def _size_sql(cols):
    return " + ".join(f"coalesce(sum(strlen({c})), 0)" for c in cols)


SIZE_COLS = ["CAST(c_custkey AS VARCHAR)", "phone", "email", "id_card", "real_name", "address", "c_mktsegment"]


@query("quality_size", with_fixtures(
    f"SELECT 'original' AS side, CAST({_size_sql(SIZE_COLS)} AS BIGINT) AS size_bytes FROM customer_pii UNION ALL "
    f"SELECT 'processed', CAST({_size_sql(SIZE_COLS)} AS BIGINT) FROM m", PII, ctes=(("m", MASKED_PII_SQL),)))
def q_quality_size(spark, sf):
    cols = ["c_custkey", "phone", "email", "id_card", "real_name", "address", "c_mktsegment"]
    b = fxt(spark, sf, PII).select(*cols)
    a = mask_columns(b, {c: MaskSpec(t) for c, t in DETECTED.items()})
    return spark.createDataFrame([("original", data_size(b)), ("processed", data_size(a))], "side string, size_bytes bigint")


def _by_col_sql(t, cols, side):
    return " UNION ALL ".join(
        f"SELECT {S.lit(side)} AS side, {S.lit(c)} AS column, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM {t}"
        for c in cols)


@query("missing_by_column", _with_after(
    _by_col_sql("orders_gaps", GAPS_COLS, "original") + " UNION ALL " + _by_col_sql("after_t", AFTER_COLS, "processed")))
def q_missing_by_column(spark, sf):
    b, a = _pair(spark, sf)
    rows = []
    for side, p in (("original", profile(b)), ("processed", profile(a))):
        rows += [(side, c, round(p.missing[c] / p.rows * 100, 2)) for c in p.columns]
    return spark.createDataFrame(rows, "side string, column string, missing_pct double")


def _report(spark, sf):
    from .operators.quality import quality_report

    b, a = _pair(spark, sf)
    return quality_report(b, a, "o_orderkey", with_size=False, exact_distinct=True)


MB = _missing_sum(GAPS_COLS, "orders_gaps")
MA = _missing_sum(AFTER_COLS, "after_t")
NB = "(SELECT count(*) * 6 FROM orders_gaps)"
NA = "(SELECT count(*) * 4 FROM after_t)"


@query("missing_total", _with_after(
    f"SELECT 'original' AS side, CAST({MB} AS BIGINT) AS total_missing, round(({MB}) / {NB} * 100, 2) AS missing_rate "
    f"UNION ALL SELECT 'processed', CAST({MA} AS BIGINT), round(({MA}) / {NA} * 100, 2)"))
def q_missing_total(spark, sf):
    m = _report(spark, sf).missing()
    return spark.createDataFrame([(s, m[s]["total_missing"], m[s]["missing_rate"]) for s in ("original", "processed")],
                                 "side string, total_missing bigint, missing_rate double")


@query("missing_improvement", _with_after(
    f"SELECT CAST(({MB}) - ({MA}) AS BIGINT) AS missing_reduction, "
    f"round(({MB}) / {NB} * 100 - ({MA}) / {NA} * 100, 2) AS rate_improvement"))
def q_missing_improvement(spark, sf):
    m = _report(spark, sf).missing()["improvement"]
    return spark.createDataFrame([(m["missing_reduction"], m["rate_improvement"])], "missing_reduction bigint, rate_improvement double")


SPARK_TYPE = ("CASE typeof(x) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
              "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' ELSE typeof(x) END")


def _types_sql(t, cols, side):
    return " UNION ALL ".join(f"SELECT {S.lit(side)} AS side, {S.lit(c)} AS column, "
                              f"{SPARK_TYPE.replace('typeof(x)', f'typeof({c})')} AS dtype FROM (SELECT * FROM {t} LIMIT 1) z" for c in cols)


@query("type_histogram", _with_after(
    f"SELECT side, dtype, count(*) AS n_columns FROM ({_types_sql('orders_gaps', GAPS_COLS, 'original')} UNION ALL "
    f"{_types_sql('after_t', AFTER_COLS, 'processed')}) t GROUP BY side, dtype"))
def q_type_histogram(spark, sf):
    return _report(spark, sf).type_histogram(spark)


@query("schema_diff", with_fixtures(
    "SELECT column, 'string' AS from_type, dtype AS to_type FROM (" +
    " UNION ALL ".join(f"SELECT {S.lit(c)} AS column, {SPARK_TYPE.replace('typeof(x)', f'typeof({c})')} AS dtype "
                       f"FROM (SELECT * FROM ({AUTO_BODY}) a LIMIT 1) z" for c in EVT_TEXT)
    + ") t WHERE dtype <> 'string'", EVT))
def q_schema_diff(spark, sf):
    from .operators.quality import QualityReport

    b = normalize_na(fxt(spark, sf, EVT))
    a = convert_types(b, infer_types(b, "event_id"))[0]
    r = QualityReport(profile(b), profile(a), 0, 0, {}, {}, {})
    return r.schema_diff(spark)


def _dist_sql(t, side):
    return (f"SELECT 'o_totalprice' AS column, {S.lit(side)} AS side, round(avg(o_totalprice), 2) AS mean, "
            f"round(stddev_samp(o_totalprice), 2) AS std, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max "
            f"FROM {t}")


@query("distribution", _with_after(
    "SELECT 'o_orderkey' AS column, side, round(avg(o_orderkey), 2) AS mean, round(stddev_samp(o_orderkey), 2) AS std, "
    "round(min(o_orderkey), 2) AS min, round(max(o_orderkey), 2) AS max FROM (SELECT 'original' AS side, o_orderkey FROM orders_gaps "
    "UNION ALL SELECT 'processed', o_orderkey FROM after_t) u GROUP BY side UNION ALL "
    + _dist_sql("orders_gaps", "original") + " UNION ALL " + _dist_sql("after_t", "processed")))
def q_distribution(spark, sf):
    r = _report(spark, sf)
    rows = []
    for c, d in r.distribution.items():
        for side in ("original", "processed"):
            x = d[side]
            rows.append((c, side) + tuple(None if x[k] is None else round(x[k], 2) for k in ("mean", "std", "min", "max")))
    return spark.createDataFrame(rows, "column string, side string, mean double, std double, min double, max double")


@query("unique_counts", _with_after(
    "SELECT 'o_orderkey' AS column, 'original' AS side, count(DISTINCT o_orderkey) AS n_distinct FROM orders_gaps UNION ALL "
    "SELECT 'o_totalprice', 'original', count(DISTINCT o_totalprice) FROM orders_gaps UNION ALL "
    "SELECT 'o_orderkey', 'processed', count(DISTINCT o_orderkey) FROM after_t UNION ALL "
    "SELECT 'o_totalprice', 'processed', count(DISTINCT o_totalprice) FROM after_t"))
def q_unique_counts(spark, sf):
    b, a = _pair(spark, sf)
    cols = ["o_orderkey", "o_totalprice"]
    return distinct_counts(b, cols).withColumn("side", F.lit("original")).unionByName(
        distinct_counts(a, cols).withColumn("side", F.lit("processed")))


@query("completeness", _with_after(
    f"SELECT 'original' AS side, round((1 - ({MB}) / {NB}) * 100, 2) AS completeness UNION ALL "
    f"SELECT 'processed', round((1 - ({MA}) / {NA}) * 100, 2)"))
def q_completeness(spark, sf):
    s = _report(spark, sf).scores()["completeness"]
    return spark.createDataFrame([("original", s["original"]), ("processed", s["processed"])], "side string, completeness double")


def _first10_checks(t, key, c):
    sub = f"(SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 10) s"
    num = f"(SELECT bool_and({S.blank('v')} OR regexp_full_match(v, '{S.NUMBER_RE}')) FROM {sub})"
    dt = f"(SELECT bool_and(try_strptime(v, '%Y-%m-%d') IS NOT NULL) FROM {sub})"
    return num, dt


def _points_sql(t, key, typed, texts, empties):
    parts = [f"SELECT CAST(1.0 AS DOUBLE) AS p" for _ in typed] + [f"SELECT CAST(0.5 AS DOUBLE)" for _ in empties]
    for c in texts:
        num, dt = _first10_checks(t, key, c)
        parts.append(f"SELECT CASE WHEN {num} OR {dt} THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END")
    return f"(SELECT avg(p) FROM ({' UNION ALL '.join(parts)}) pts)"


CB = _points_sql("orders_gaps", "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderdate"], ["o_orderpriority", "mostly_missing"], ["all_missing"])
CA = _points_sql("after_t", "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderdate"], ["o_orderpriority"], [])


@query("consistency", _with_after(f"SELECT 'original' AS side, round({CB} * 100, 2) AS consistency UNION ALL "
                                  f"SELECT 'processed', round({CA} * 100, 2)"))
def q_consistency(spark, sf):
    s = _report(spark, sf).scores()["consistency"]
    return spark.createDataFrame([("original", s["original"]), ("processed", s["processed"])], "side string, consistency double")


def _checks_sql():
    rows = []
    for c in EVT_TEXT:
        num, dt = _first10_checks("events_text", "event_id", c)
        rows.append(f"SELECT {S.lit(c)} AS column, {num} AS should_be_numeric, {dt} AS should_be_datetime")
    return with_fixtures(" UNION ALL ".join(rows), EVT)


CHECKS_SQL = _checks_sql()


@query("should_be_numeric", f"SELECT column, should_be_numeric FROM ({CHECKS_SQL}) c")
def q_should_be_numeric(spark, sf):
    return text_checks(fxt(spark, sf, EVT), "event_id", EVT_TEXT).select("column", "should_be_numeric")


@query("should_be_datetime", f"SELECT column, should_be_datetime FROM ({CHECKS_SQL}) c")
def q_should_be_datetime(spark, sf):
    return text_checks(fxt(spark, sf, EVT), "event_id", EVT_TEXT).select("column", "should_be_datetime")


COMP_B = f"(1 - ({MB}) / {NB})"
COMP_A = f"(1 - ({MA}) / {NA})"


@query("quality_score", _with_after(
    f"SELECT 'completeness' AS metric, round({COMP_B} * 100, 2) AS original, round({COMP_A} * 100, 2) AS processed, "
    f"round(({COMP_A} - {COMP_B}) * 100, 2) AS improvement UNION ALL "
    f"SELECT 'consistency', round({CB} * 100, 2), round({CA} * 100, 2), round(({CA} - {CB}) * 100, 2) UNION ALL "
    f"SELECT 'overall', round(({COMP_B} * 0.6 + {CB} * 0.4) * 100, 2), round(({COMP_A} * 0.6 + {CA} * 0.4) * 100, 2), "
    f"round((({COMP_A} * 0.6 + {CA} * 0.4) - ({COMP_B} * 0.6 + {CB} * 0.4)) * 100, 2)"))
def q_quality_score(spark, sf):
    s = _report(spark, sf).scores()
    return spark.createDataFrame([(k, v["original"], v["processed"], v["improvement"]) for k, v in s.items()],
                                 "metric string, original double, processed double, improvement double")


@query("score_comparison", f"SELECT metric, original, processed FROM ({ORACLE['quality_score']}) q")
def q_score_comparison(spark, sf):
    return _report(spark, sf).score_comparison(spark)


@query("change_summary", _with_after(
    "SELECT (SELECT count(*) FROM after_t) - (SELECT count(*) FROM orders_gaps) AS rows_added, CAST(-2 AS BIGINT) AS columns_added, "
    "'' AS new_columns, 'mostly_missing|all_missing' AS removed_columns"))
def q_change_summary(spark, sf):
    s = _report(spark, sf).change_summary()
    return spark.createDataFrame([(s["rows_added"], s["columns_added"], "|".join(s["new_columns"]), "|".join(s["removed_columns"]))],
                                 "rows_added bigint, columns_added bigint, new_columns string, removed_columns string")


def _metrics_sql():
    def dbl(x):
        return f"CAST({x} AS DOUBLE)"

    parts = []
    for side, t, cols, n in (("original", "orders_gaps", GAPS_COLS, 6), ("processed", "after_t", AFTER_COLS, 4)):
        parts.append(f"SELECT 'basic' AS section, 'rows' AS metric, NULL AS column, {S.lit(side)} AS side, {dbl('count(*)')} AS value FROM {t}")
        parts.append(f"SELECT 'basic', 'columns', NULL, {S.lit(side)}, {dbl(n)}")
        for c in cols:
            parts.append(f"SELECT 'missing', 'missing_pct', {S.lit(c)}, {S.lit(side)}, round((count(*) - count({c})) / count(*) * 100, 2) FROM {t}")
    for side, m, nn in (("original", MB, NB), ("processed", MA, NA)):
        parts.append(f"SELECT 'missing', 'total_missing', NULL, {S.lit(side)}, {dbl(m)}")
        parts.append(f"SELECT 'missing', 'missing_rate', NULL, {S.lit(side)}, round(({m}) / {nn} * 100, 2)")
    parts.append(f"SELECT 'missing', 'missing_reduction', NULL, 'improvement', {dbl(f'({MB}) - ({MA})')}")
    parts.append(f"SELECT 'missing', 'rate_improvement', NULL, 'improvement', round(({MB}) / {NB} * 100 - ({MA}) / {NA} * 100, 2)")
    ob, oa = f"({COMP_B} * 0.6 + {CB} * 0.4)", f"({COMP_A} * 0.6 + {CA} * 0.4)"
    for metric, b, a in (("completeness", COMP_B, COMP_A), ("consistency", CB, CA), ("overall", ob, oa)):
        parts.append(f"SELECT 'score', {S.lit(metric)}, NULL, 'original', round({b} * 100, 2)")
        parts.append(f"SELECT 'score', {S.lit(metric)}, NULL, 'processed', round({a} * 100, 2)")
        parts.append(f"SELECT 'score', {S.lit(metric)}, NULL, 'improvement', round(({a} - {b}) * 100, 2)")
    for c in ("o_orderkey", "o_totalprice"):
        for side, t in (("original", "orders_gaps"), ("processed", "after_t")):
            for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                parts.append(f"SELECT 'distribution', {S.lit(k)}, {S.lit(c)}, {S.lit(side)}, round({dbl(f'{f}({c})')}, 2) FROM {t}")
            parts.append(f"SELECT 'distribution', 'unique_count', {S.lit(c)}, {S.lit(side)}, {dbl(f'count(DISTINCT {c})')} FROM {t}")
    return _with_after(" UNION ALL ".join(parts))


@query("quality_report", _metrics_sql())
def q_quality_report(spark, sf):
    return _report(spark, sf).metrics_frame(spark)


# ------------------------------------------------------------------------------------------------
# 2.10 pipelines (customer_pii)
# ------------------------------------------------------------------------------------------------

def _pipeline(spark, sf, features: bool, materialize: bool = False):
    from .plans.pipeline import run

    opts = PrepOptions(order_by="c_custkey", feature_extraction=FeatureOptions(enable_extraction=features))
    return run(fxt(spark, sf, PII), opts, report=False, materialize=materialize)


@query("pipeline_simple", with_fixtures(MASKED_PII_SQL, PII))
def q_pipeline_simple(spark, sf):
    return _pipeline(spark, sf, False).data


def _pipeline_full_sql():
    num = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_is_null, abs({c}) AS {c}_abs" for c in ("c_custkey", "c_acctbal"))
    txt = ", ".join(f"CAST(length({c}) AS BIGINT) AS {c}_length, {S.word_count(c)} AS {c}_word_count, {S.is_empty(c)} AS {c}_is_empty"
                    for c in ["phone", "email", "id_card", "real_name", "address", "c_mktsegment"])
    return with_fixtures(f"SELECT *, {num}, {txt} FROM ({MASKED_PII_SQL}) m", PII)


@query("pipeline_full", _pipeline_full_sql())
def q_pipeline_full(spark, sf):
    return _pipeline(spark, sf, True).data


@query("pipeline_file", with_fixtures(MASKED_PII_SQL, PII))
def q_pipeline_file(spark, sf):
    from .plans.pipeline import run_path

    src = scratch(spark, "pipe-src")
    dst = scratch(spark, "pipe-dst")
    write_table(fxt(spark, sf, PII), src, "csv")
    run_path(spark, src, dst, PrepOptions(order_by="c_custkey"))
    return read_table(spark, dst, "parquet")


def _steps_sql(name, source, limit):
    ok = f"(SELECT count(*) <= {limit} FROM {source})"
    return (f"SELECT '{name}' AS run, CAST(CASE WHEN {ok} THEN 5 ELSE 1 END AS BIGINT) AS total_steps, CAST(CASE WHEN {ok} THEN 5 ELSE 0 END AS BIGINT) "
            f"AS successful_steps, CAST(CASE WHEN {ok} THEN 0 ELSE 1 END AS BIGINT) AS failed_steps, CASE WHEN {ok} THEN (SELECT count(*) FROM "
            f"({_decision_sql()}) d WHERE should_mask) ELSE 0 END AS masked_columns_count, CAST(0 AS BIGINT) AS extracted_features_count")


RUN_LIMITS = {"wide": 1_000_000_000, "tight": 10}      # rows that a run of customer_pii accepts


@query("run_summary", with_fixtures(" UNION ALL ".join(_steps_sql(n, "customer_pii", k) for n, k in RUN_LIMITS.items()), PII))
def q_run_summary(spark, sf):
    """Q19 of a run that succeeds and of one that its row limit stops at the first step."""
    from .plans.pipeline import PrepError, log_frame, log_summary, run

    parts = []
    for name, limit in RUN_LIMITS.items():
        try:
            s = run(fxt(spark, sf, PII), PrepOptions(order_by="c_custkey", max_rows=limit), materialize=False).run_summary(spark)
        except PrepError as e:
            s = log_summary(log_frame(spark, e.log))
        parts.append(s.select(F.lit(name).alias("run"), "*"))
    return parts[0].unionByName(parts[1])


@query("failed_run", "SELECT 'data_validation' AS step, 'failed' AS status, 'too_many_rows ' || count(*) || ' > 10' AS error FROM customer HAVING count(*) > 10")
def q_failed_run(spark, sf):
    """A failed run raises with its log and gives no rows."""
    from .plans.pipeline import PrepError, log_frame, run

    try:
        run(table(spark, sf, "customer"), PrepOptions(order_by="c_custkey", max_rows=10))
    except PrepError as e:
        error = F.regexp_replace(F.regexp_extract(F.col("details")["errors"], r"\(([^)]*)\)", 1), "[',]", "")
        return log_frame(spark, e.log).select("step", "status", F.regexp_replace(error, " +", " ").alias("error"))
    raise AssertionError("the run did not fail")


def _gain_sql():
    norm = "SELECT event_id, " + ", ".join(
        f"CASE WHEN {c} IN ({', '.join(S.lit(t) for t in NA_TOKENS)}) THEN NULL ELSE {c} END AS {c}" for c in EVT_TEXT) \
        + " FROM events_text"
    before = _points_sql("nb", "event_id", ["event_id"], EVT_TEXT, [])
    # after conversion: numbers and dates are typed, the rest stays text
    conv = [c for c in EVT_TEXT if c not in ("flag_text", "event_type")]
    after = _points_sql("nb", "event_id", ["event_id"] + conv, ["flag_text", "event_type"], [])
    return with_fixtures(f"SELECT round({before} * 100, 2) AS original, round({after} * 100, 2) AS processed, "
                         f"round({after} * 100, 2) - round({before} * 100, 2) AS gain", EVT, ctes=(("nb", norm),))


@query("run_log", "SELECT run_id, step, status FROM (VALUES ('data_validation', 'success'), ('table_standardization', 'success'), "
                  "('missing_data_handling', 'success'), ('data_masking', 'success'), ('quality_report', 'success')) "
                  "t(step, status), (VALUES ('first'), ('second')) r(run_id) WHERE (SELECT count(*) FROM customer) > 0")
def q_run_log(spark, sf):
    """The log of a job that is retried is there once, and doesn't touch another run's."""
    from .plans.pipeline import run

    res = run(fxt(spark, sf, PII), PrepOptions(order_by="c_custkey"), materialize=False)
    path = scratch(spark, "run-log")
    for run_id in ("first", "second", "first"):
        res.append_log(spark, path, run_id)
    return spark.read.parquet(path).select(F.col("run_id").cast("string").alias("run_id"), "step", "status")


@query("united_distinct", "SELECT 'c_custkey' AS column, true AS within_3_percent FROM customer HAVING count(DISTINCT c_custkey) > 0")
def q_united_distinct(spark, sf):
    """Q9 over two runs of overlapping parts of a table, from the sketches kept with the run log."""
    from .plans.pipeline import run, united_distinct

    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    path = scratch(spark, "run-log")
    for run_id, part in (("low", "c_custkey % 3 <> 0"), ("high", "c_custkey % 3 <> 1")):
        run(c.where(part), PrepOptions(order_by="c_custkey"), materialize=False).append_log(spark, path, run_id)
    n = c.select(F.count_distinct("c_custkey").alias("n"))
    u = united_distinct(spark, path).where("side = 'original' AND column = 'c_custkey'")
    return u.join(F.broadcast(n)).select("column", (F.abs(F.col("n_distinct") - F.col("n")) <= 0.03 * F.col("n")).alias("within_3_percent"))


@query("consistency_gain", _gain_sql())
def q_consistency_gain(spark, sf):
    """Q20 as the standardization step logs it: one evidence pass for both scores."""
    from .plans.pipeline import fit

    log: list = []
    found = fit(normalize_na(fxt(spark, sf, EVT)), PrepOptions(order_by="event_id"), log).consistency
    told = next(details["consistency"] for step, _, _, details, _ in log if step == "table_standardization")
    assert told == f"{found['original']} -> {found['processed']}, gain {found['gain']}"
    return spark.createDataFrame([(found["original"], found["processed"], found["gain"])], "original double, processed double, gain double")


def _text_report_sql():
    """The report's lines from the metrics' SQL."""
    shown = "coalesce(format('{:.10g}', value), '-')"
    by = lambda side: f"max(CASE WHEN side = '{side}' THEN {shown} END)"
    line = (f"rpad(section, 8, ' ') || rpad(metric, 20, ' ') || concat_ws(', ', concat_ws(' -> ', {by('original')}, {by('processed')}), "
            f"'improvement ' || {by('improvement')})")
    line = line.replace("concat_ws(', ', concat_ws", "concat_ws(', ', nullif(concat_ws").replace(f"{by('processed')}), ", f"{by('processed')}), ''), ")
    return (f"SELECT 'Data quality report' AS line UNION ALL SELECT {line} FROM ({ORACLE['quality_report']}) m WHERE column IS NULL GROUP BY section, metric")


@query("text_report", _text_report_sql())
def q_text_report(spark, sf):
    """Q16, line by line."""
    return spark.createDataFrame([(x,) for x in _report(spark, sf).text().split("\n")], "line string")


# ------------------------------------------------------------------------------------------------
# 2.11 what a run must not lose or show (tables derived from the generated ones)
# ------------------------------------------------------------------------------------------------

NUMBER_IDS = ("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 1 THEN 13800000000 + c_custkey END AS phone, "
              "CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS nation FROM customer")


@query("protect_numeric_ids", f"SELECT c_custkey, '138****' || right(CAST(phone AS VARCHAR), 4) AS phone FROM ({NUMBER_IDS}) t")
def q_protect_numeric_ids(spark, sf):
    """A whole-number phone column with gaps takes no mean and is masked."""
    from .plans.pipeline import run

    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return run(spark.sql(NUMBER_IDS), PrepOptions(order_by="c_custkey"), report=False).data.select("c_custkey", "phone")


MIXED_DATES = ("SELECT o_orderkey, CASE WHEN o_orderkey <= (SELECT quantile_disc(o_orderkey, 0.5) FROM orders) "
               "THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day FROM orders")


@query("cast_loss", "SELECT 'day' AS column, count(*) AS lost, false AS converted FROM orders "
                    "WHERE o_orderkey > (SELECT quantile_disc(o_orderkey, 0.5) FROM orders)")
def q_cast_loss(spark, sf):
    """Dates in a format that the first values don't show: counted, and the column stays text."""
    from .plans.pipeline import fit

    o = table(spark, sf, "orders")
    half = exact_medians(o, {"h": (F.col("o_orderkey"), None)})["h"]
    half = F.lit(None if half is None else math.floor(half)).cast("long")
    d = o.select("o_orderkey", F.when(F.col("o_orderkey") <= half, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day"))
    f = fit(d, PrepOptions(order_by="o_orderkey"))
    rows = [(c, n, any(x.column == c for x in f.auto_casts)) for c, n in f.cast_loss.items()]
    return spark.createDataFrame(rows, "column string, lost long, converted boolean")


@query("fill_nan_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN (SELECT avg(o_custkey) FROM orders WHERE o_orderkey % 5 <> 0) "
                        "ELSE CAST(o_custkey AS DOUBLE) END AS v FROM orders")
def q_fill_nan_text(spark, sf):
    """Text nan is missing once the column is numeric, and filled."""
    from .plans.pipeline import run

    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("nan")).otherwise(F.col("o_custkey").cast("double").cast("string")).alias("v"))
    return run(d, PrepOptions(order_by="o_orderkey"), report=False).data


@query("fill_forward_composite", "SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_orderkey % 4 <> 1 THEN l_quantity END IGNORE NULLS) OVER "
                                 "(ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM lineitem")
def q_fill_forward_composite(spark, sf):
    d = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_orderkey") % 4 != 1, F.col("l_quantity")).alias("q"))
    return ordered_fill(d, ["q"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_shipdate", "l_partkey", "l_suppkey")


@query("fill_forward_text_key", "SELECT k, first_value(CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END IGNORE NULLS) OVER "
                                "(ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v "
                                "FROM (SELECT 'order-' || reverse(CAST(o_orderkey AS VARCHAR)) AS k, * FROM orders) t")
def q_fill_forward_text_key(spark, sf):
    d = table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.reverse(F.col("o_orderkey").cast("string"))).alias("k"),
                                          F.when(F.col("o_orderkey") % 3 != 1, F.col("o_totalprice")).alias("v"))
    return ordered_fill(d, ["v"], "k", "backward")


@query("column_errors", "SELECT 'too_many_columns' AS code, '' AS subject, '5 > 4' AS value, count(*) AS rows FROM nation "
                        "UNION ALL SELECT 'duplicate_column', 'n_name', 'exact', count(*) FROM nation")
def q_column_errors(spark, sf):
    """V3, V4: too many columns, and a name that occurs twice, beside the row count of the same pass."""
    n = table(spark, sf, "nation")
    n = n.select("n_nationkey", "n_name", "n_regionkey", F.col("n_name"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    v = validate(n, max_columns=4)
    return spark.createDataFrame([(*e, v.stats["rows"]) for e in v.errors], "code string, subject string, value string, rows long")


@query("run_validation", "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, true AS valid FROM customer")
def q_run_validation(spark, sf):
    """P5: the validation in a run's result."""
    from .plans.pipeline import run

    v = run(table(spark, sf, "customer"), PrepOptions(order_by="c_custkey"), report=False).validation
    return spark.createDataFrame([(v.stats["rows"], v.stats["columns"], v.valid)], "rows long, columns long, valid boolean")


FORMATS = ["csv", "json", "parquet", "orc", "xlsx", "txt"]


@query("export_formats", "SELECT format, CASE WHEN format IN ('csv', 'json', 'parquet', 'orc') THEN (SELECT count(*) FROM nation) END AS rows FROM (VALUES "
                         + ", ".join(f"('{f}')" for f in FORMATS) + ") t(format)")
def q_export_formats(spark, sf):
    """IO5-IO7: rows read back from each format; an unknown one is refused before anything is written."""
    rows = []
    for f in FORMATS:
        path = scratch(spark, "format")
        try:
            write_table(table(spark, sf, "nation"), path, f)
            rows.append((f, read_table(spark, path, f).count()))
        except ValueError:
            rows.append((f, None))
    return spark.createDataFrame(rows, "format string, rows bigint")


@query("failed_conversion", "SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority, CAST(o_custkey AS DOUBLE) AS o_custkey FROM "
                            "(SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority, o_custkey FROM orders)")
def q_failed_conversion(spark, sf):
    """A conversion that doesn't apply to a column's type leaves the column as it is."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", F.col("o_custkey").cast("double").alias("o_custkey"))
    return apply_type_mapping(o, {"o_orderdate": "numeric", "o_totalprice": "datetime", "o_custkey": "boolean", "nothing": "text"})[0]


_NAME_ENDS = ["_phone", "Tel", " identity", "_mail_to", "Name", "_location", "_no", "电话", "_nationkey"]


def _by_name_sql():
    e = "'none'"
    for t in reversed(P.SENSITIVE_TYPES):
        e = f"CASE WHEN {' OR '.join(f'contains(lower(n), {S.lit(k)})' for k in P.NAME_KEYWORDS[t])} THEN '{t}' ELSE {e} END"
    ends = ", ".join(f"({S.lit(x)})" for x in _NAME_ENDS)
    return f"SELECT n AS column, {e} AS name_type FROM (SELECT DISTINCT c_mktsegment || x AS n FROM customer, (VALUES {ends}) v(x)) t"


@query("detect_by_name", _by_name_sql())
def q_detect_by_name(spark, sf):
    """D2 for names made of the market segments (one of which holds a keyword)."""
    from .operators.sensitive import name_candidates

    segments = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]
    return name_candidates(spark, [s + x for s in segments for x in _NAME_ENDS]).select("column", "name_type")


@query("malformed_rows", "SELECT format, good, malformed, records FROM (SELECT 'csv' AS format, count(*) FILTER (c_custkey % 10 <> 0) AS good, "
                         "count(*) FILTER (c_custkey % 10 = 0) AS malformed, string_agg(CASE WHEN c_custkey % 10 = 0 THEN c_custkey || ',' || c_name || ',extra,' END, "
                         "'|' ORDER BY c_custkey) AS records FROM customer UNION ALL SELECT 'json', count(*) FILTER (c_custkey % 15 <> 0), "
                         "count(*) FILTER (c_custkey % 15 = 0), string_agg(CASE WHEN c_custkey % 15 = 0 THEN '{\"k\":' || c_custkey || ',' END, '|' ORDER BY c_custkey) "
                         "FROM customer) t")
def q_malformed_rows(spark, sf):
    """IO1, IO2: rows with cells beyond the header, and broken JSON lines, are handed over whole; short rows are rows."""
    from .sources.io import read_checked

    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    lines = {"csv": F.concat_ws(",", k, F.when(k % 7 != 0, F.col("c_name")).when(k % 10 == 0, F.col("c_name")), F.when(k % 10 == 0, "extra,")),
             "json": F.when(k % 15 == 0, F.concat(F.lit('{"k":'), k, F.lit(","))).otherwise(F.to_json(F.struct(k.alias("k"), "c_name")))}
    out = []
    for fmt, line in lines.items():
        path = scratch(spark, "malformed")
        text = c.select(k.alias("i"), line.alias("value"))
        if fmt == "csv":
            text = text.unionByName(spark.createDataFrame([(-1, "k,name")], "i long, value string"))
        text.repartition(1).sortWithinPartitions("i").select("value").write.text(path)
        got = read_checked(spark, path, fmt)
        number = F.regexp_extract("record", "([0-9]+)", 1).cast("long")
        bad = got.malformed.agg(F.count("*").alias("malformed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "record"))),
                                                                                         lambda x: x["record"]), "|").alias("records"))
        out.append(got.data.agg(F.count("*").alias("good")).join(F.broadcast(bad)).select(F.lit(fmt).alias("format"), "good", "malformed", "records"))
    return out[0].unionByName(out[1])


@query("preview_counts", with_fixtures(f"SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST({_gaps_missing} AS BIGINT) AS missing_cells FROM orders_gaps", GAPS))
def q_preview_counts(spark, sf):
    return preview_counts(fxt(spark, sf, GAPS))


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def _quote_reserved(sql: str) -> str:
    """``column`` is a reserved word in DuckDB: quote it where it is used as a name."""
    return re.sub(r'(?<![\w"\'])column(?![\w"\'])', '"column"', sql)


def oracle_sql() -> dict[str, str]:
    return {k: _quote_reserved(v) for k, v in ORACLE.items() if v is not None}
