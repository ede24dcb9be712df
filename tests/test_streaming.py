"""A fitted preparation applied to a file stream equals the batch result."""
import os
import tempfile

from tableprep.plans.options import PrepOptions
from tableprep.plans.pipeline import fit
from tableprep.streaming.stream import NotStreamable, run_stream_once

from .conftest import SF_SMALL


def test_stream_equals_batch(spark):
    from tableprep.fixtures import fixture

    d = tempfile.mkdtemp(prefix="tp-stream-")
    src = os.path.join(d, "src")
    pii = fixture(spark, SF_SMALL, "customer_pii")
    pii.write.parquet(src)
    batch = spark.read.parquet(src)
    fitted = fit(batch, PrepOptions(order_by="c_custkey"))
    stream = spark.readStream.schema(batch.schema).parquet(src)
    run_stream_once(fitted, stream, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    got = spark.read.parquet(os.path.join(d, "out"))
    want = fitted.transform(batch)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_ordered_fill_refused(spark):
    import pytest
    from tableprep.operators.impute import FillOptions

    df = spark.createDataFrame([(1, None), (2, 1.0)], "k long, v double")
    fitted = fit(df, PrepOptions(order_by="k", missing_handling=FillOptions(default_strategy="forward_fill")))
    with pytest.raises(NotStreamable):
        fitted.transform_stream(spark.readStream.format("rate").load().selectExpr("value as k", "cast(null as double) as v"))
