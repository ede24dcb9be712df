"""Names and type inference (fixture types5) and casts."""
import datetime as dt

from tableprep.functions.naming import convert_names, named
from tableprep.operators.standardize import convert_types, drop_duplicate_columns, infer_types, rename_columns


def test_naming():
    assert named("User Name", "snake_case") == "user_name"
    assert named("userID", "snake_case") == "user_id"
    assert named("first-name", "snake_case") == "firstname"
    assert named("用户 Name!", "snake_case") == "用户_name"
    assert named("User Name", "camelCase") == "userName"
    assert named("created date", "PascalCase") == "CreatedDate"
    assert convert_names(["User Name", "user_name", "USER NAME"], "snake_case") == ["user_name", "user_name_2", "user_name_3"]
    assert convert_names(["a b"], "kebab") == ["a b"]


def types5(spark):
    rows = [(1, "Alice", 25, "True", "2023-01-01"), (2, "Bob", 30, "False", "2023-01-02"), (3, "Charlie", 35, "True", "2023-01-03"),
            (4, "David", 40, "True", "2023-01-04"), (5, "Eve", 45, "False", "2023-01-05")]
    return spark.createDataFrame(rows, "user_id bigint, `User Name` string, Age bigint, IsActive string, `Created Date` string")


def test_types5(spark):
    df = types5(spark)
    d = infer_types(df, "user_id")
    assert [x.detected for x in d] == ["numeric", "text", "numeric", "boolean", "datetime"]
    renamed, mapping = rename_columns(df)
    assert renamed.columns == ["user_id", "user_name", "age", "is_active", "created_date"]
    out, changes = convert_types(df, d)
    assert changes == {"Created Date": ("string", "timestamp_ntz")}    # boolean text stays text (A5)
    assert out.orderBy("user_id").first()["Created Date"] == dt.datetime(2023, 1, 1)
    out2, ch2 = convert_types(df, d, text_booleans=True)
    assert ch2["IsActive"] == ("string", "boolean")


def test_numeric_text(spark):
    df = spark.createDataFrame([(1, " 12 ", "1.5", "1e3", None), (2, "-7", "x", "2", "")], "k int, a string, b string, c string, d string")
    d = {x.column: x for x in infer_types(df, "k")}
    assert d["a"].detected == "numeric" and d["a"].target == "bigint"
    assert d["b"].detected != "numeric"
    assert d["c"].target == "double"
    out, _ = convert_types(df, list(d.values()))
    assert [r.a for r in out.orderBy("k").collect()] == [12, -7]


def test_drop_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert drop_duplicate_columns(df).collect()[0].asDict() == {"a": 1, "b": 2}


def test_text_datetime_is_wall_clock_in_any_zone(spark):
    from pyspark.sql import functions as F

    from tableprep.functions.columns import to_datetime

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("bad",), ("2024-11-03 01:30:00",)], "s string")
        got = [r.t for r in df.select(to_datetime(F.col("s"), "yyyy-M-d H:m:s").alias("t")).collect()]
        assert got == [dt.datetime(2024, 3, 10, 2, 30), None, dt.datetime(2024, 11, 3, 1, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_zoned_and_month_name_dates(spark):
    from pyspark.sql import functions as F

    from tableprep.functions.columns import to_datetime

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([("2024-01-05T10:00:00Z",), ("2024-01-05T10:00:00.5+08:00",), ("x",)], "s string")
        z = [r.t for r in df.select(F.coalesce(to_datetime(F.col("s"), "yyyy-M-d'T'H:m:s.SSSSSSXXX"),
                                               to_datetime(F.col("s"), "yyyy-M-d'T'H:m:sXXX")).alias("t")).collect()]
        assert z == [dt.datetime(2024, 1, 5, 10, 0), dt.datetime(2024, 1, 5, 2, 0, 0, 500000), None]
        m = spark.createDataFrame([("Jan 5, 2024",)], "s string").select(to_datetime(F.col("s"), "MMM d, yyyy").alias("t"))
        assert m.first().t == dt.datetime(2024, 1, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_lower_bound_of_distinct_values_never_counts_too_many(spark):
    """Columns near the limit of the categorical test: decided exactly, whatever their hashes."""
    from pyspark.sql import functions as F

    from tableprep.operators.profile import at_least_distinct
    from tableprep.operators.standardize import infer_types

    df = spark.range(0, 2000).select("id", *[F.concat(F.lit(f"c{k}-"), (F.col("id") % k).cast("string")).alias(f"c{k}") for k in (1, 2, 48, 49, 50, 51, 199, 1999)])
    floor = df.agg(*[at_least_distinct(F.col(f"c{k}")).alias(f"c{k}") for k in (1, 2, 48, 49, 50, 51, 199, 1999)]).first()
    assert all(0.9 * k <= floor[f"c{k}"] <= k for k in (1, 2, 48, 49, 50, 51, 199, 1999))
    got = {d.column: d.detected for d in infer_types(df, "id")}
    assert [got[f"c{k}"] for k in (1, 2, 48, 49, 50, 51, 199)] == ["categorical"] * 4 + ["text"] * 3
