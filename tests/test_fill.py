"""Missing-value handling: two-phase ordered fill equals the plain window; exact median; drop order."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.operators import impute as I
from tableprep.operators.ordered_fill import boundaries, ordered_fill, with_bucket

from .window_fill import ordered_fill_window
from tableprep.operators.quantile import exact_medians, ordered_bits, value_of

from .conftest import SF_MID


def _gappy(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, rnd.random()]), rnd.choice([None, None, "a", "b", "c"]), rnd.randrange(4)) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k long, x double, s string, g int").repartition(5)


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_two_phase_equals_window(spark, direction, buckets):
    df = _gappy(spark)
    a = ordered_fill(df, ["x", "s"], "k", direction, buckets=buckets)
    b = ordered_fill_window(df, ["x", "s"], "k", direction)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_two_phase_with_partition_keys(spark):
    df = _gappy(spark)
    a = ordered_fill(df, ["x"], "k", "forward", partition_by=["g"], buckets=5)
    b = ordered_fill_window(df, ["x"], "k", "forward", partition_by=["g"])
    assert a.exceptAll(b).count() == 0


def test_two_phase_on_events(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet").select(
        "event_id", "ts", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("value")).alias("v"))
    a = ordered_fill(ev, ["v"], "ts", "forward", buckets=16)
    b = ordered_fill_window(ev, ["v"], "ts", "forward")
    assert a.exceptAll(b).count() == 0


def test_big_side_not_single_partition(spark):
    df = _gappy(spark)
    plan = ordered_fill(df, ["x"], "k", "forward", buckets=8)._jdf.queryExecution().executedPlan().toString()
    # the only single-partition exchange is the carry over at most B bucket rows
    assert plan.count("SinglePartition") <= 1
    assert "hashpartitioning(__bucket" in plan


@pytest.mark.parametrize("keys, parts", [(["k"], None), (["t", "k"], None), (["k"], ["g"]), (["name"], None)])
def test_backward_fill_takes_running_frames_only(spark, keys, parts):
    """A frame up to the end of its partition is computed anew for each row: the square of a bucket's rows."""
    df = spark.range(40_000).selectExpr("id AS k", "concat('t', id % 3) AS t", "concat('order-', lpad(id, 6, '0')) AS name", "id % 2 AS g", "CASE WHEN id % 10000 < 2 THEN id END AS v")
    got = ordered_fill(df, ["v"], keys, "backward", parts, buckets=2)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    if keys != ["t", "k"]:
        marks = [x for x in range(40_000) if x % 10000 < 2]
        for r in got.collect():
            assert r.v == next((x for x in marks if x >= r.k and (parts is None or x % 2 == r.g)), None)


def test_exact_median_of_few_values(spark):
    for values, want in (([1.0], 1.0), ([], None), ([2.0, 1.0], 1.5), ([float(v) for v in range(10)], 4.5), ([-0.0, 0.0, 5.0], 0.0),
                         ([float("-inf"), float("-inf"), 1.0], float("-inf")), ([float("nan"), 3.0], 3.0)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert exact_medians(df, {"v": (F.col("v"), None)}) == {"v": want}


def test_bits_order_as_doubles(spark):
    rnd = np.random.default_rng(9)
    raw = np.frombuffer(rnd.bytes(8 * 4000), np.float64)
    values = [float(x) for x in raw[np.isfinite(raw)]]
    edges = [2.0 ** e for e in range(-1074, 1024, 7)]
    edges += [np.nextafter(x, 0) for x in edges] + [np.nextafter(x, np.inf) for x in edges] + [0.0, 5e-324, 1.7976931348623157e308, float("inf"), 2.0 ** -1022]
    values += [float(x) for x in edges] + [-float(x) for x in edges]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = sorted(r["b"] for r in ordered_bits(df, {"b": F.col("v")}).collect())
    assert [value_of(b) for b in got] == sorted(values)
    assert ordered_bits(df.limit(1), {"b": F.lit(float("nan"))}).first()["b"] is None


def test_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert I.modes(df, {"s": None}) == {"s": "a"}


def test_fill_after_drop_uses_filtered_rows(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, "x", None), (3, "y", 20.0), (4, None, 1000.0)], "k int, d string, v double")
    out, plan = I.fill_missing(df, I.FillOptions(column_strategies={"d": "drop"}), order_by="k")
    assert [(r.k, r.v) for r in out.orderBy("k").collect()] == [(2, 20.0), (3, 20.0)]   # mean over kept rows only


def test_fills_keep_non_missing_cells(spark):
    df = _gappy(spark)
    for strategy in ("mean", "median", "mode", "forward_fill", "backward_fill"):
        out, _ = I.fill_missing(df, I.FillOptions(default_strategy=strategy, missing_threshold=1.0), order_by="k")
        j = df.alias("a").join(out.alias("b"), "k")
        assert j.where("a.x IS NOT NULL AND a.x <> b.x").count() == 0, strategy


def test_fit_is_deterministic_and_partition_independent(spark):
    df = _gappy(spark)
    p1 = I.fit_fills(df, I.FillOptions(default_strategy="median"))
    p2 = I.fit_fills(df.repartition(11), I.FillOptions(default_strategy="median"))
    assert [(s.column, s.kind, s.value) for s in p1.steps] == [(s.column, s.kind, s.value) for s in p2.steps]


def test_custom_value_type_checked(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "k int, v double")
    with pytest.raises(ValueError):
        I.fit_fills(df, I.FillOptions(custom_fill_values={"v": "abc"}))


def test_ordered_fill_wall_clock_keys_under_dst_zone(spark):
    """Bucket keys of timestamp_ntz ignore the session zone (a spring-forward hour must not reorder rows)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-03-10 00:00:00', timestamp_ntz'2024-03-10 05:00:00', "
                       "interval 10 minutes)) AS t").withColumn("v", F.when(F.minute("t") == 0, F.hour("t")))
        a = ordered_fill(df, ["v"], "t", "forward", buckets=7)
        b = ordered_fill_window(df, ["v"], "t", "forward")
        assert a.exceptAll(b).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_exact_medians_match_numpy(spark):
    rnd = np.random.default_rng(3)
    n = 6001
    cols = {"a": rnd.normal(size=n), "b": np.where(rnd.random(n) < 0.5, 1.0, 2.0),           # ranks straddle two heavy values
            "c": np.concatenate([rnd.exponential(size=n - 3000), np.full(3000, 7.0)]),      # a heavy value and a long tail
            "d": rnd.integers(0, 10, size=n).astype(float), "e": rnd.standard_cauchy(size=n) * 10.0 ** rnd.integers(-300, 300, size=n),
            "f": 1.0 + rnd.integers(0, 40_000, size=n) * 2.0 ** -52}                          # equal but for the last bits
    rows = [(i, *(float(x[i]) for x in cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in cols))
    specs = {x: (F.col(x), None) for x in cols} | {"even": (F.col("e"), F.col("k") > 0), "none": (F.col("a"), F.lit(False))}
    got = exact_medians(df, specs)
    assert got == exact_medians(df.repartition(7), specs, columns_a_job=2)
    for x, arr in cols.items():
        assert got[x] == float(np.median(arr)), x
    assert got["even"] == float(np.median(cols["e"][1:])) and got["none"] is None


def test_medians_take_at_most_five_jobs(spark):
    """A count and four rounds, also where half of all values are equal and the rest has a long tail."""
    df = spark.range(50_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1.0D WHEN id % 4 = 1 THEN exp(id / 100.0) ELSE -id / 7.0 END AS v")
    tracker, group = spark.sparkContext.statusTracker(), "medians"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = exact_medians(df, {"v": (F.col("v"), None)})["v"]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == df.selectExpr("median(v) AS m").first()["m"]
    assert len(tracker.getJobIdsForGroup(group)) <= 5 * 4     # adaptive execution runs a stage as a job


def test_approx_median_option_close_to_exact(spark):
    df = _gappy(spark)
    exact = I.fit_fills(df, I.FillOptions(default_strategy="median", missing_threshold=1.0))
    approx = I.fit_fills(df, I.FillOptions(default_strategy="median", missing_threshold=1.0, approx_median=True))
    e = {s.column: s.value for s in exact.steps}
    a = {s.column: s.value for s in approx.steps}
    assert set(e) == set(a) == {"x"} and abs(e["x"] - a["x"]) < 0.01


def _days(spark, n=8000, days=1, at=0):
    return spark.range(at, at + n).selectExpr(f"cast(date_add(date'2024-01-01', cast(id % {days} AS int)) AS date) AS day", "id", "concat('k', lpad(cast(id AS string), 9, '0')) AS name", "CASE WHEN id % 7 = 3 THEN id END AS v")


@pytest.mark.parametrize("keys, days", [(["day", "id"], 1), (["day", "id"], 3), (["name"], 1), (["day", "name"], 2), (["id"], 1), (["v", "id"], 1)])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_ordered_fill_over_composite_and_text_keys(spark, keys, days, direction):
    df = _days(spark, 3000, days)
    a = ordered_fill(df, ["v"], keys, direction, buckets=16)
    b = ordered_fill_window(df, ["v"], keys, direction)
    assert a.exceptAll(b).count() == 0 and a.count() == 3000


@pytest.mark.parametrize("keys, days", [(["day", "id"], 1), (["day", "id"], 5), (["id"], 1), (["long_name"], 1), (["day", "long_name"], 2),
                                        (["day", "same", "id"], 1), (["same", "name"], 1), (["half", "id"], 1), (["amount"], 1)])
def test_no_bucket_holds_much_more_than_its_share(spark, keys, days):
    for at in (0, 80_000):      # another table gets boundaries of its own
        df = _days(spark, 8000, days, at).selectExpr("*", "concat('customer-2024-', name) AS long_name", "'x' AS same",
                                                     "CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS half", "cast(id * 1.5 AS decimal(20, 2)) AS amount")
        sizes = [r["count"] for r in with_bucket(df, keys, boundaries(df, keys, 16), "b").groupBy("b").count().collect()]
        assert sum(sizes) == 8000 and max(sizes) < 3 * 8000 / 16


def test_null_order_and_partition_keys(spark):
    rows = [(None, 1, 5), (None, 2, None), ("a", None, 7), ("a", 3, None), ("a", 4, None)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = sorted(ordered_fill(df, ["v"], "k", "forward", ["g"], buckets=3).collect(), key=str)
    assert sorted(r["v"] for r in got) == [5, 5, 7, 7, 7]


def test_cast_loss_finds_its_middle_key_without_gathering_the_keys(spark, tmp_path, monkeypatch):
    """The exact percentile function holds every distinct key in one task, and did so again in each job of the fit."""
    from tableprep import queries
    from tableprep.plans import pipeline

    plans, fit = [], pipeline.fit
    monkeypatch.setattr(pipeline, "fit", lambda d, *a: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or fit(d, *a))
    for case, keys, lost in (("even", list(range(40)), 20), ("odd", list(range(41)), 20), ("again", [1] * 14 + [8] * 14, 14)):
        folder = str(tmp_path / case)
        rows = spark.createDataFrame([(k,) for k in keys], "o_orderkey long").withColumn("o_orderdate", F.lit("1995-03-17").cast("timestamp"))
        rows.write.parquet(f"{folder}/orders.parquet")
        got = queries.queries()["cast_loss"](spark, folder).first()
        assert (got["column"], got["lost"], got["converted"]) == ("day", lost, False), case
    assert len(plans) == 3 and not any("percentile" in p or "Join" in p for p in plans)
