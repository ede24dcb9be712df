"""Sources, sinks and validation."""
import os
import tempfile

import pytest

from tableprep.operators.validate import validate
from tableprep.sources.io import detect_format, normalize_na, read_table, write_table


def test_detect_format():
    assert detect_format("/x/a.CSV") == "csv"
    assert detect_format("/x/a.json") == "json"
    with pytest.raises(ValueError):
        detect_format("/x/a.txt")
    with pytest.raises(ValueError):
        detect_format("/x/a.xlsx")


def test_round_trip_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="tp-io-")
    df = spark.createDataFrame([(1, "n/a", "x"), (2, "NULL", None), (3, "ok", "y")], "k int, a string, b string")
    write_table(df, os.path.join(d, "t.csv"), "csv")
    back = read_table(spark, os.path.join(d, "t.csv"))
    assert [r.a for r in back.orderBy("k").collect()] == [None, None, "ok"]
    write_table(df, os.path.join(d, "t.json"), "json")
    assert read_table(spark, os.path.join(d, "t.json")).count() == 3
    with pytest.raises(ValueError):
        write_table(df, os.path.join(d, "t.xlsx"), "xlsx")
    assert normalize_na(df).where("a IS NULL").count() == 2


def test_validate(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "k int, e string, s string")
    v = validate(df)
    assert v.valid and [w[1] for w in v.warnings] == ["e"]
    v = validate(df, max_rows=1)
    assert not v.valid and v.errors[0][0] == "too_many_rows"
    dup = df.toDF("k", "k", "s")
    assert any(e[0] == "duplicate_column" for e in validate(dup).errors)
    assert not validate(df.where("k > 5")).valid
    sparse = spark.createDataFrame([(None, None, None, None, None, 1)], "a int, b int, c int, d int, e int, f int")
    assert any(e[0] == "missing_rate" for e in validate(sparse).errors)


def test_json_array_detected(spark):
    d = tempfile.mkdtemp(prefix="tp-json-")
    p = os.path.join(d, "a.json")
    with open(p, "w") as fh:
        fh.write('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    df = read_table(spark, p)
    assert sorted(r.a for r in df.collect()) == [1, 2]


def test_options_are_checked():
    from tableprep.operators.impute import FillOptions
    from tableprep.plans.options import MaskingOptions, StandardizeOptions

    for bad in (lambda: FillOptions(default_strategy="zero"), lambda: FillOptions(missing_threshold=2),
                lambda: MaskingOptions(default_strategy="blur"), lambda: MaskingOptions(sensitivity_threshold=-1),
                lambda: MaskingOptions(column_rules={"a": {"type": "iban"}}),
                lambda: StandardizeOptions(naming_convention="kebab"),
                lambda: StandardizeOptions(custom_type_mapping={"a": "money"})):
        with pytest.raises(ValueError):
            bad()


def test_command_line_job(spark, tmp_path):
    import subprocess
    import sys

    from tableprep.fixtures import fixture

    from .conftest import SF_SMALL

    src = str(tmp_path / "in.csv")
    fixture(spark, SF_SMALL, "customer_pii").write.option("header", True).csv(src)
    env = dict(os.environ, PYSPARK_SUBMIT_ARGS="--conf spark.ui.enabled=false --master local[2] pyspark-shell")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    r = subprocess.run([sys.executable, "-m", "tableprep", src, str(tmp_path / "out"), "--order-by", "c_custkey",
                        "--format", "csv", "--log", str(tmp_path / "log")], cwd=repo, env=env,
                       capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "Data quality report" in r.stdout
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == spark.read.option("header", True).csv(src).count()
    assert out.where("phone LIKE '%****%'").count() > 0


def test_csv_multiline_and_custom_tokens(spark, tmp_path):
    from tableprep.sources.io import read_csv

    p = tmp_path / "m.csv"
    p.write_text('k,note\n1,"two\nlines"\n2,-\n3,plain\n', encoding="utf-8")
    df = read_csv(spark, str(p), multiline=True, na_tokens=["-"])
    rows = {r.k: r.note for r in df.collect()}
    assert rows == {"1": "two\nlines", "2": None, "3": "plain"}


def test_malformed_records(spark, tmp_path):
    from tableprep.sources.io import read_checked, read_csv

    p = tmp_path / "a.csv"
    p.write_text('k,a b.c\n1,x\n2,y,EXTRA\n3\n4,z,\n5,"q,r"\n6,w,1,2,3\n', encoding="utf-8")
    c = read_checked(spark, str(p))
    assert [tuple(r) for r in c.data.orderBy("k").collect()] == [("1", "x"), ("3", None), ("4", "z"), ("5", "q,r")]
    assert sorted(r["record"] for r in c.malformed.collect()) == ["2,y,EXTRA", "6,w,1,2,3"] and c.count_malformed() == 2
    with pytest.raises(Exception, match="malformed record"):
        read_csv(spark, str(p)).select("k").collect()
    j = tmp_path / "b.json"
    j.write_text('{"a":1,"b":"x"}\n{"a":2,"b":\n5\n{"a":3}\n', encoding="utf-8")
    c = read_checked(spark, str(j))
    assert c.data.columns == ["a", "b"] and c.data.count() == 2 and sorted(r["record"] for r in c.malformed.collect()) == ["5", '{"a":2,"b":']
    with pytest.raises(Exception, match="malformed record"):
        read_table(spark, str(j)).count()
    j = tmp_path / "c.json"
    j.write_text('[{"a":1},{"a":2}', encoding="utf-8")
    assert read_checked(spark, str(j)).count_malformed() == 1
