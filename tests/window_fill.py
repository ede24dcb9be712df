"""The plain window version of an ordered fill, as a brute-force check."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.functions.columns import col, is_missing
from tableprep.operators.ordered_fill import _keys


def ordered_fill_window(df: DataFrame, columns: list[str], order_by, direction: str = "forward",
                        partition_by: list[str] | None = None) -> DataFrame:
    """Plain window version (one partition per key group); for tests."""
    keys = _keys(order_by)
    fwd = direction == "forward"
    w = Window.partitionBy(*[col(p) for p in (partition_by or [])]).orderBy(*[col(k).asc_nulls_first() for k in keys])
    w = w.rowsBetween(Window.unboundedPreceding, 0) if fwd else w.rowsBetween(0, Window.unboundedFollowing)
    take = F.last if fwd else F.first
    out = []
    for f in df.schema.fields:
        if f.name in columns:
            v = F.when(~is_missing(col(f.name), f.dataType), col(f.name))
            out.append(take(v, ignorenulls=True).over(w).cast(f.dataType).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)
