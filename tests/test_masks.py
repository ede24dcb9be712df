"""Masking expressions on two values of each type."""
from pyspark.sql import functions as F

from tableprep.functions.masks import mask

CASES = {
    "phone": ["13900010002", "15000020003"],
    "id_card": ["440300198802290017", "51010719751231002X"],
    "email": ["heminm@corp.test", "dengt@mail.test"],
    "name": ["何敏", "郭子轩"],
    "address": ["成都市武侯区人民南路9号", "广州市天河区体育东路"],
}
PARTIAL = {
    "phone": ["139****0002", "150****0003"],
    "id_card": ["440300********0017", "510107********002X"],
    "email": ["he****@corp.test", "de***@mail.test"],
    "name": ["何*", "郭**"],
    "address": ["成都市武侯区人民****", "广州市天河*****"],
}


def _apply(spark, values, t, strategy, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.m for r in df.select("i", mask(F.col("v"), t, strategy, **kw).alias("m")).orderBy("i").collect()]


def test_partial(spark):
    for t, vals in CASES.items():
        assert _apply(spark, vals, t, "partial") == PARTIAL[t], t


def test_remove_and_hash(spark):
    for t, vals in CASES.items():
        assert _apply(spark, vals, t, "remove") == ["[已删除]"] * 2
    assert _apply(spark, ["何敏"], "name", "hash") == ["52ceff9d"]
    assert _apply(spark, ["何敏"], "name", "hash", hash_len=12)[0].startswith("52ceff9d")


def test_random_shapes_and_stability(spark):
    import re

    ph = _apply(spark, CASES["phone"] * 2, "phone", "random", seed=3)
    assert all(re.fullmatch(r"1[358]\d{9}", p) for p in ph)
    assert ph[0] == ph[2] and ph[1] == ph[3]          # keyed: same value, same output
    assert _apply(spark, CASES["phone"], "phone", "random", seed=4) != ph[:2]
    ids = _apply(spark, CASES["id_card"], "id_card", "random")
    assert all(re.fullmatch(r"\d{17}[\dX]", x) for x in ids)
    em = _apply(spark, CASES["email"], "email", "random")
    assert all(re.fullmatch(r"[a-z]{5,10}@(example\.com|test\.com|demo\.org|sample\.net)", x) for x in em)
    nm = _apply(spark, CASES["name"], "name", "random")
    assert all(2 <= len(x) <= 3 for x in nm)
    tx = _apply(spark, CASES["address"], "address", "random")
    assert [len(x) for x in tx] == [len(x) for x in CASES["address"]] and all(x.isalnum() for x in tx)


def test_blank_and_null_kept(spark):
    for strategy in ("partial", "hash", "random", "remove"):
        out = _apply(spark, [None, "", "   "], "phone", strategy)
        assert out == [None, "", "   "], strategy


def test_generic_and_unknown_strategy(spark):
    assert _apply(spark, ["abcd", "abcdefg"], "text", "partial") == ["****", "ab***fg"]
    assert _apply(spark, ["13812345678"], "phone", "nonsense") == ["138****5678"]


def test_no_python_udf_in_plan(spark):
    df = spark.createDataFrame([("13812345678",)], "v string")
    plan = df.select(mask(F.col("v"), "phone"), mask(F.col("v"), "email", "hash"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_summary_hides_originals_unless_asked(spark):
    from tableprep.operators.masking import MaskSpec, mask_summary

    df = spark.createDataFrame([(i, f"1381234{i:04d}") for i in range(10)], "k int, phone string")
    s = mask_summary(df, {"phone": MaskSpec("phone")}, "k").first()
    assert "original_preview" not in s.asDict() and s.masked_preview == ["138****0000", "138****0001", "138****0002"]
    s2 = mask_summary(df, {"phone": MaskSpec("phone")}, "k", include_originals=True).first()
    assert s2.original_preview == ["13812340000", "13812340001", "13812340002"]
