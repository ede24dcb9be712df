"""Text of numbers as Python prints them (D15 and the sample text), and guarded casts."""
import random

from pyspark.sql import functions as F

from tableprep.functions.columns import number_to_text, py_float_text, to_number


def test_py_float_text_matches_python(spark):
    rnd = random.Random(7)
    vals = [0.0, -0.0, 0.1, 1e-4, 9.999e-5, 1e-5, 13812345678.0, 1e16, 1.5e16, 1e22, 3.3488001055878643e+212,
            -0.00021280062724417204, 5000.5, 6000.0, float("inf"), -float("inf"), 2e23, 6.558263133135596e+18,
            8.275530396996133e+17, 0.30000000000000004, 1.7976931348623157e+308, 2.2250738585072014e-308]
    vals += [round(rnd.uniform(-1e7, 1e7), rnd.randrange(0, 5)) for _ in range(2000)]
    vals += [rnd.uniform(0, 1000) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", py_float_text(F.col("v")).alias("t")).collect()}
    bad = [(v, got[i]) for i, v in enumerate(vals) if got[i] != str(v)]
    assert not bad, bad[:5]


def test_number_to_text_drops_whole_fraction(spark):
    df = spark.createDataFrame([(13812345678.0,), (5000.5,), (float("nan"),), (None,), (2e16,)], "v double")
    got = [r.t for r in df.select(number_to_text(F.col("v")).alias("t")).collect()]
    assert got == ["13812345678", "5000.5", "nan", None, "2e+16"]


def test_to_number_guards(spark):
    df = spark.createDataFrame([(" 12 ",), ("1d",), ("1.0f",), ("0x10",), ("",), ("1e3",), ("99999999999999999999",)], "s string")
    got = [(r.l, r.d) for r in df.select(to_number(F.col("s"), True).alias("l"), to_number(F.col("s"), False).alias("d")).collect()]
    assert got == [(12, 12.0), (None, None), (None, None), (None, None), (None, None), (None, 1000.0), (None, 1e20)]
