"""End to end on small tables of people with one gap in each column."""
import pytest

from tableprep.operators.features import FeatureOptions
from tableprep.operators.quality import quality_report
from tableprep.plans.options import MaskingOptions, PrepOptions
from tableprep.plans.pipeline import PrepError, fit, run


def people5(spark):
    rows = [(11, "何敏", 31.0, "13900010002", "heminm@corp.test", 4100.0), (12, "郭子轩", None, "15000020003", "guozx@corp.test", 5200.0),
            (13, "唐宁", 29.0, None, "tangning@mail.test", None), (14, "罗佳", 52.0, "18800040005", None, 6300.0),
            (15, "邓涛", 44.0, "13700050006", "dengt@mail.test", 4400.0)]
    return spark.createDataFrame(rows, "user_id bigint, `User Name` string, Age double, Phone string, Email string, Salary double")


def test_people5(spark):
    res = run(people5(spark), PrepOptions(order_by="user_id"), materialize=False)
    rows = [r.asDict() for r in res.data.orderBy("user_id").collect()]
    assert list(rows[0]) == ["user_id", "user_name", "age", "phone", "email", "salary"]
    assert rows[1]["age"] == 39.0 and rows[2]["salary"] == 5000.0
    assert [r["user_name"] for r in rows] == ["何*", "郭**", "唐*", "罗*", "邓*"]
    assert [r["phone"] for r in rows] == ["139****0002", "150****0003", None, "188****0005", "137****0006"]
    assert [r["email"] for r in rows] == ["he****@corp.test", "gu***@corp.test", "ta******@mail.test", None, "de***@mail.test"]
    assert {r[0] for r in res.log} >= {"data_validation", "table_standardization", "missing_data_handling", "data_masking", "quality_report"}


def test_features_and_transform_reuse(spark):
    df = people5(spark)
    opts = PrepOptions(order_by="user_id", feature_extraction=FeatureOptions(enable_extraction=True))
    fitted = fit(df, opts)
    out = fitted.transform(df)
    assert "age_abs" in out.columns and "email_word_count" in out.columns and "user_name_length" in out.columns
    again = fitted.transform(df.where("user_id > 12"))      # the fitted constants apply to other rows
    assert again.where("user_id = 13").first()["salary"] == 5000.0


def test_column_rules_and_threshold(spark):
    df = people5(spark)
    opts = PrepOptions(order_by="user_id", masking_rules=MaskingOptions(
        column_rules={"salary": {"strategy": "remove"}}, sensitivity_threshold=0.95))
    out = run(df, opts, materialize=False, report=False).data
    r = out.orderBy("user_id").first()
    assert r["salary"] == "[已删除]" and r["phone"] == "13900010002"   # phone 0.9 < 0.95


def test_invalid_table_fails_with_log(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "k int, v string").selectExpr("k", "v", "v as w", "v as x", "v as y", "v as z")
    with pytest.raises(PrepError) as e:
        run(df, PrepOptions(order_by="k"))
    assert e.value.log[0][1] == "failed"


def test_quality4_scores(spark):
    before = spark.createDataFrame(
        [("何敏", "41", "13900010002", 61.0), (None, "52", "15000020003", None), ("唐宁", None, None, 70.5),
         ("罗佳", "38", "18800040005", 66.0)], "name string, age string, phone string, score double")
    after = spark.createDataFrame(
        [("何*", 41, "139****0002", 61.0), ("x*", 52, "150****0003", 65.0), ("唐*", 44, "131****0009", 70.5),
         ("罗*", 38, "188****0005", 66.0)], "name string, age bigint, phone string, score double")
    r = quality_report(before, after, None)
    s = r.scores()
    assert (s["completeness"]["original"], s["completeness"]["processed"]) == (75.0, 100.0)
    assert (s["consistency"]["original"], s["consistency"]["processed"]) == (60.0, 90.0)
    assert (s["overall"]["original"], s["overall"]["processed"]) == (69.0, 96.0)
    assert r.missing()["improvement"]["missing_reduction"] == 4
    assert "75 -> 100" in next(x for x in r.text().split("\n") if "completeness" in x)


def test_distinct_counts_are_sketches_unless_exact_ones_are_asked_for(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 20000).select("id", (F.col("id") % 997).alias("m"), (F.col("id") * 0.5).alias("h"))
    exact = quality_report(df, df, "id", exact_distinct=True)
    approx = quality_report(df, df, "id")
    for c in ("m", "h"):
        assert abs(approx.unique_before[c] - exact.unique_before[c]) <= 0.03 * exact.unique_before[c]
    assert exact.unique_before["m"] == 997 and not exact.sketches and set(approx.sketches) == {(s, c) for s in ("original", "processed") for c in ("id", "m", "h")}
    told = {r["metric"] for r in approx.metrics_frame(spark).collect()}
    assert "unique_estimate" in told and "unique_count" not in told


def test_sketches_of_runs_are_united(spark, tmp_path):
    from tableprep.plans.pipeline import united_distinct

    path = str(tmp_path / "log")
    for run_id, at in (("a", 0), ("b", 600), ("a", 0)):
        df = spark.range(at, at + 1000).selectExpr("id", "cast(id % 50 AS double) AS v")
        run(df, PrepOptions(order_by="id"), materialize=False).append_log(spark, path, run_id)
    got = {(r["side"], r["column"]): r["n_distinct"] for r in united_distinct(spark, path).collect()}
    assert abs(got[("original", "id")] - 1600) < 50 and abs(got[("processed", "v")] - 50) <= 1
    one = {(r["side"], r["column"]): r["n_distinct"] for r in united_distinct(spark, path, ["a"]).collect()}
    assert abs(one[("original", "id")] - 1000) < 30


def test_malformed_rows_of_a_run(spark, tmp_path):
    from tableprep.plans.pipeline import run_path

    src = tmp_path / "in.csv"
    src.write_text("k,phone\n1,13800000001\n2,13800000002,lost?\n3\n4,13800000004,\n", encoding="utf-8")
    res = run_path(spark, str(src), str(tmp_path / "out"), PrepOptions(order_by="k"))
    assert res.n_malformed == 1 and res.malformed.first()["record"] == "2,13800000002,lost?"
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]
    assert res.log[0][0] == "reading"
    with pytest.raises(PrepError):
        run_path(spark, str(src), str(tmp_path / "out2"), PrepOptions(order_by="k"), on_malformed="error")
    assert not (tmp_path / "out2").exists()
    with pytest.raises(ValueError):
        run_path(spark, str(src), str(tmp_path / "out3"), PrepOptions(order_by="k"), out_fmt="xlsx")


def test_consistency_gain_in_the_log(spark):
    df = spark.createDataFrame([(1, "5", "x", None), (2, "6", "y", None)], "id int, n string, t string, e string")
    res = run(df, PrepOptions(order_by="id"), materialize=False)
    # id 1, n 0.3 -> 1, t 0.8, e 0.5 and dropped
    assert res.fitted.consistency == {"original": 65.0, "processed": 93.33, "gain": 28.33}
    assert any("gain 28.33" in d.get("consistency", "") for _, _, _, d, _ in res.log)


def test_verdicts_mark_more_columns(spark):
    df = people5(spark)
    verdicts = spark.createDataFrame([("salary", True, "text"), ("nope", True, "phone")],
                                     "column string, is_sensitive boolean, suggested_type string")
    out = run(df, PrepOptions(order_by="user_id"), materialize=False, report=False, verdicts=verdicts).data
    assert out.orderBy("user_id").first()["salary"] == "41**.0"


def test_log_appends(spark):
    import os
    import tempfile

    d = os.path.join(tempfile.mkdtemp(prefix="tp-log-"), "log")
    res = run(people5(spark), PrepOptions(order_by="user_id"), materialize=False, report=False)
    res.append_log(spark, d, "a")
    res.append_log(spark, d, "b")
    got = spark.read.parquet(d)
    assert got.select("run_id").distinct().count() == 2 and got.count() == 2 * len(res.log)


def test_report_reuse_of_unchanged_columns_is_exact(spark):
    from tableprep.operators.quality import quality_report

    df = people5(spark)
    res = run(df, PrepOptions(order_by="user_id"), materialize=False)
    assert "user_id" in res.fitted.unchanged_columns() and "salary" not in res.fitted.unchanged_columns()
    full = quality_report(df, res.data, "user_id")
    assert res.report.metrics_frame(spark).exceptAll(full.metrics_frame(spark)).count() == 0


def test_pipeline_ordered_fill_with_partition_keys(spark):
    from tableprep.operators.impute import FillOptions
    from .window_fill import ordered_fill_window

    rows = [(i, i % 3, None if i % 4 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    opts = PrepOptions(order_by="k", partition_by=("g",), missing_handling=FillOptions(default_strategy="forward_fill"))
    got = run(df, opts, report=False).data
    want = ordered_fill_window(df, ["v"], "k", "forward", partition_by=["g"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_text_booleans_option(spark):
    from pyspark.sql import types as T

    from tableprep.plans.options import StandardizeOptions

    df = spark.createDataFrame([(i, "yes" if i % 2 else "no") for i in range(20)], "k int, flag string")
    keep = run(df, PrepOptions(order_by="k"), materialize=False, report=False).data
    conv = run(df, PrepOptions(order_by="k", standardization=StandardizeOptions(text_booleans=True)),
               materialize=False, report=False).data
    assert isinstance(keep.schema["flag"].dataType, T.StringType)
    assert isinstance(conv.schema["flag"].dataType, T.BooleanType)
    assert conv.where("flag").count() == 10


def test_rules_only_and_missing_order_by(spark):
    df = people5(spark)
    opts = PrepOptions(order_by="user_id", masking_rules=MaskingOptions(enable_auto_detection=False,
                                                                        column_rules={"email": {"type": "email"}}))
    out = run(df, opts, materialize=False, report=False)
    assert set(out.fitted.masks) == {"email"}
    assert out.data.orderBy("user_id").first()["phone"] == "13900010002"
    with pytest.raises(PrepError) as e:
        run(df, PrepOptions(), materialize=False)
    assert "order_by" in str(e.value)


def _phones(spark, n=60):
    return spark.range(n).selectExpr("id AS k", "CASE WHEN id % 4 <> 1 THEN 13800000000 + id * 37 END AS phone", "id * 1.5 AS amount", "CASE WHEN id % 3 <> 0 THEN concat('u', id, '@corp.test') END AS email")


def test_number_phones_with_gaps_are_masked(spark):
    res = run(_phones(spark), PrepOptions(order_by="k"), report=False)
    rows = res.data.orderBy("k").collect()
    assert res.fitted.masks["phone"].masking_type == "phone"
    assert rows[0]["phone"] == "138****0000" and rows[1]["phone"] is None


def test_no_clear_value_is_left_behind(spark):
    import os

    from tableprep.operators.impute import FillOptions
    from tableprep.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    opts = PrepOptions(order_by="k", missing_handling=FillOptions(default_strategy="mode"))
    res = run(_phones(spark), opts, report=False)
    assert set(os.listdir(base)) == before          # no ordered fill, nothing written
    assert "corp.test" not in str(res.log) and "13800000" not in str(res.log)
    res = run(_phones(spark), PrepOptions(order_by="k", missing_handling=FillOptions(default_strategy="forward_fill")), report=False)
    left = set(os.listdir(base)) - before
    assert len(left) == 1
    stored = spark.read.parquet(os.path.join(base, left.pop()))
    assert all("****" in r["phone"] for r in stored.collect()) and all("*" in r["email"] for r in stored.where("email IS NOT NULL").collect())
    res.cleanup()
    assert set(os.listdir(base)) == before


def test_random_masks_differ_between_runs(spark):
    opts = PrepOptions(order_by="k", masking_rules=MaskingOptions(default_strategy="random"))
    one, two = (run(_phones(spark), opts, report=False) for _ in range(2))
    assert one.fitted.mask_opts.seed != two.fitted.mask_opts.seed and str(one.fitted.mask_opts.seed) not in str(one.log)
    pick = lambda r: [x["phone"] for x in r.data.orderBy("k").collect()]
    assert pick(one) != pick(two) and pick(one) == pick(one)


def test_dates_that_would_be_lost_stay_text(spark):
    df = spark.range(24).selectExpr("id AS k", "CASE WHEN id < 12 THEN concat('2024-01-', id + 1) ELSE concat(id, '.1.2024') END AS d", "concat('2024-02-', id + 1) AS e")
    res = run(df, PrepOptions(order_by="k"), report=False)
    assert dict(res.data.dtypes)["d"] == "string" and dict(res.data.dtypes)["e"].startswith("timestamp")
    assert res.fitted.cast_loss == {"d": 12, "e": 0} and "'d': 12" in str(res.log)
    from tableprep.plans.options import StandardizeOptions
    res = run(df, PrepOptions(order_by="k", standardization=StandardizeOptions(max_cast_loss=0.5)), report=False)
    assert res.data.where("d IS NULL").count() == 12


def test_text_nan_is_missing_and_filled(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, "nan"), (3, "2.5"), (4, " NaN ")], "k long, v string")
    assert [r["v"] for r in run(df, PrepOptions(order_by="k"), report=False).data.orderBy("k").collect()] == [1.5, 2.0, 2.5, 2.0]


def test_more_than_a_million_rows(spark):
    assert run(spark.range(1_000_001).withColumnRenamed("id", "k"), PrepOptions(order_by="k"), report=False).data.count() == 1_000_001


def test_result_has_validation_and_previews(spark):
    res = run(people5(spark), PrepOptions(order_by="user_id", masking_rules=MaskingOptions(include_originals=True)), report=False)
    assert res.validation.valid and res.validation.stats["rows"] == 5
    s = {r["column"]: r for r in res.masking_summary(spark).collect()}
    assert s["phone"]["masked_preview"] == ["139****0002", "150****0003", "188****0005"] and s["phone"]["original_preview"][0] == "13900010002"
    res = run(people5(spark), PrepOptions(order_by="user_id"), report=False)
    assert "original_preview" not in res.masking_summary(spark).columns
