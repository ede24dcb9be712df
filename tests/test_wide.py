"""Tables of a thousand columns."""
import pytest
from pyspark.sql import functions as F

from tableprep.operators.quality import data_size
from tableprep.operators.sample import first_values
from tableprep.operators.validate import basic_stats, preview_counts

N = 1000


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(40).select("id", *[(F.when(F.col("id") % 5 != i % 5, F.col("id") * 0.5 + i)).alias(f"c{i}") for i in range(N)])


def test_basic_stats_and_size(spark, wide):
    r = basic_stats(wide).first()
    assert (r["rows"], r["columns"], r["missing_cells"]) == (40, N + 1, 8 * N)
    assert tuple(preview_counts(wide).first()) == (40, N + 1, 8 * N)
    assert data_size(wide) > 32 * N * 3


def test_first_values(spark, wide):
    got = first_values(wide, [f"c{i}" for i in range(200)], "id", 3).collect()
    assert len(got) == 600 and {r["value"] for r in got if r["column"] == "c0"} == {"0.5", "1.0", "1.5"}
