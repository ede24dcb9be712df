"""Physical-plan checks: native expressions only, bounded shuffles, no single-task windows over the data."""
import random

from pyspark.sql import functions as F

from tableprep.fixtures import fixture
from tableprep.operators.features import FeatureOptions
from tableprep.operators.impute import FillOptions
from tableprep.operators.ordered_fill import ordered_fill

from .window_fill import ordered_fill_window
from tableprep.operators.sample import first_values
from tableprep.operators.standardize import distinct_counts
from tableprep.plans.options import PrepOptions
from tableprep.plans.pipeline import fit

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fitted_transform_is_native(spark):
    pii = fixture(spark, SF_SMALL, "customer_pii")
    fitted = fit(pii, PrepOptions(order_by="c_custkey", feature_extraction=FeatureOptions(enable_extraction=True),
                                  missing_handling=FillOptions(default_strategy="mode")))
    plan = _plan(fitted.transform(pii))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_sample_keeps_heaps_only(spark):
    """Whatever the key's type: cells are expanded and sorted above the top-k of rows, never below it."""
    pii = fixture(spark, SF_SMALL, "customer_pii").selectExpr("*", "concat('c-', c_custkey) AS name")
    for key in ("c_custkey", "name", ["c_mktsegment", "name"]):
        plan = _plan(first_values(pii, ["phone", "email", "real_name"], key, 20))
        assert "TakeOrderedAndProject" in plan
        below = plan[plan.index("TakeOrderedAndProject"):]
        assert not any(x in below for x in ("Expand", "Sort", "Window", "Exchange"))


def test_distinct_counts_aggregate_before_shuffle(spark):
    plan = _plan(distinct_counts(spark.range(1000).select((F.col("id") % 7).alias("a")), ["a"]))
    # a partial aggregate sits below the first exchange
    assert plan.count("HashAggregate") >= 3


def test_ordered_fill_with_hot_partition_key(spark):
    rnd = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rnd.randrange(1, 50), rnd.choice([None, float(i)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, g int, v double").repartition(6)
    a = ordered_fill(df, ["v"], "k", "forward", partition_by=["g"], buckets=12)
    b = ordered_fill_window(df, ["v"], "k", "forward", partition_by=["g"])
    assert a.exceptAll(b).count() == 0
    # the hot key 0 (a third of the rows) is spread over the buckets of the window partitioning
    plan = _plan(a)
    assert "hashpartitioning(g" in plan and "__bucket" in plan


def test_names_with_dots_and_spaces(spark):
    from tableprep.operators.sensitive import detect_sensitive

    df = spark.createDataFrame([(i, f"1381234{i:04d}") for i in range(30)], "`my.id` int, `contact phone` string")
    r = {x.column: x.detected_type for x in detect_sensitive(df, "my.id").collect()}
    assert r["contact phone"] == "phone"


def test_run_output_reads_the_written_copy(spark):
    from tableprep.operators.impute import FillOptions
    from tableprep.plans.pipeline import run

    pii = fixture(spark, SF_SMALL, "customer_pii")
    res = run(pii, PrepOptions(order_by="c_custkey", missing_handling=FillOptions(default_strategy="forward_fill")), report=False)
    plan = _plan(res.data)
    ckpt = spark.conf.get("spark.checkpoint.dir")
    assert "FileScan parquet" in plan and "tableprep-" in plan and ckpt.split("/")[-1] in plan
    assert "Window" not in plan and "Exchange" not in plan      # nothing upstream is recomputed
