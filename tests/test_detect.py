"""Sensitive detection on a group of values of each type, and name keywords."""
import pytest

from tableprep.functions.predicates import name_type
from tableprep.operators.sensitive import detect_sensitive, mask_decision

GROUPS = [
    ("mobile", ["13900010002", "15000020003", "188-0004-0005"], "phone", 0.9),
    ("citizen_id", ["440300198802290017", "51010719751231002X"], "id_card", 1.0),
    ("mail", ["heminm@corp.test", "dengt@mail.test"], "email", 0.8),
    ("real_name", ["何敏", "郭子轩", "唐宁"], "name", 0.7),
    ("home_addr", ["成都市武侯区人民南路9号", "广州市天河区体育东路"], "address", 0.6),
    ("amount", ["12", "3456", "78.9"], "none", 0.0),
]


@pytest.mark.parametrize("field,values,expected,score", GROUPS)
def test_groups(spark, field, values, expected, score):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, `{field}` string")
    r = {x.column: x for x in detect_sensitive(df, "i", [field]).collect()}[field]
    assert (r.detected_type, r.score) == (expected, score)


def test_name_keywords():
    assert name_type("Mobile_No") == "phone"
    assert name_type("hotel") == "phone"          # substring match, as in the reference
    assert name_type("citizen_id") == "id_card"
    assert name_type("E_Mail") == "email"
    assert name_type("username") == "name"
    assert name_type("home_addr") == "address"
    assert name_type("amount") == "none"


def test_value_based_and_threshold(spark):
    df = spark.createDataFrame([(i, f"1381234{i:04d}", "x") for i in range(30)], "i int, col_a string, col_b string")
    det = detect_sensitive(df, "i")
    rows = {r.column: r for r in det.collect()}
    assert rows["col_a"].detected_type == "phone" and rows["col_b"].detected_type == "none"
    dec = {r.column: r for r in mask_decision(det, threshold=0.95).collect()}
    assert not dec["col_a"].should_mask
    dec = {r.column: r for r in mask_decision(det).collect()}
    assert dec["col_a"].should_mask and dec["col_a"].masking_type == "phone"


def test_sample_is_first_values_in_order(spark):
    from tableprep.operators.sample import first_values

    df = spark.createDataFrame([(i, None if i % 2 else str(100 - i)) for i in range(100)], "i int, v string").repartition(7)
    got = [r.value for r in first_values(df, ["v"], "i", 5).orderBy("pos").collect()]
    assert got == ["100", "98", "96", "94", "92"]


def window_first_values(df, columns, keys, n):
    """The same by a window over all cells."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    x = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "column", "value").where("value IS NOT NULL")
    w = Window.partitionBy("column").orderBy(*keys)
    return x.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= n).select("column", "pos", "value")


@pytest.mark.parametrize("key", ["k", "name", "amount"])
@pytest.mark.parametrize("told", [False, True])
def test_sample_of_dense_sparse_and_empty_columns(spark, key, told):
    """Any key type, with and without the caller's counts; some columns have few values, some none, some only late ones."""
    from pyspark.sql import functions as F

    from tableprep.operators.sample import first_values

    df = spark.range(0, 20000).select((F.col("id") * 7 % 20000).alias("k"), "id").select(
        "k", F.concat(F.lit("customer-2024-"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("name"), F.col("k").cast("decimal(20,2)").alias("amount"),
        F.when(F.col("id") % 1000 == 3, F.col("id").cast("string")).alias("sparse"), F.col("id").cast("string").alias("dense"),
        F.lit(None).cast("string").alias("none"), F.when(F.col("k") > 19990, "late").alias("late"),
        F.when(F.col("k") % 150 == 149, F.col("id").cast("string")).alias("some"), F.when(F.col("k") == 19999, "one").alias("one"))
    cols = ["sparse", "dense", "none", "late", "some", "one"]
    counts = {c: df.where(F.col(c).isNotNull()).count() for c in cols} if told else None
    a = first_values(df, cols, key, 20, counts=counts, rows=20000 if told else None)
    b = window_first_values(df, cols, [key], 20)
    assert a.count() == 70 and a.exceptAll(b).count() == 0
    assert first_values(df.limit(0), cols, key, 20).count() == 0 and first_values(df, [], key, 20).count() == 0


def test_sample_text_of_numbers_and_composite_key(spark):
    from tableprep.operators.sample import first_values

    rows = [(i // 3, i % 3, [13812345678.0, 0.1, 1e-05, 1.5e16, float("nan"), -2.5][i % 6], i % 2 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b int, d double, f boolean")
    a = first_values(df, ["d", "f"], ["a", "b"], 7)
    got = {(r.column, r.pos): r.value for r in a.collect()}
    assert [got[("d", p)] for p in range(1, 7)] == ["13812345678.0", "0.1", "1e-05", "1.5e+16", "-2.5", "13812345678.0"]
    assert [got[("f", p)] for p in range(1, 4)] == ["True", "False", "True"]


def test_sample_on_wall_clock_key_in_other_zone(spark):
    from pyspark.sql import functions as F

    from tableprep.operators.sample import first_values

    from .conftest import SF_MID

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ev = spark.read.parquet(f"{SF_MID}/events.parquet").select("ts", "event_type", F.col("value").cast("decimal(18,4)").alias("value"))
        a = first_values(ev, ["event_type", "value"], "ts", 20)
        b = window_first_values(ev, ["event_type", "value"], ["ts"], 20)
        assert a.count() == 40 and a.exceptAll(b).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
