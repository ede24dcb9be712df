"""Streaming use of a fitted preparation (build step 8).

Everything a ``FittedPrep`` does per row (drop/rename/cast columns, literal fills, row drops,
masks, features) is a stateless projection or filter and runs unchanged on a streaming
DataFrame. Ordered fills need the neighbouring rows of the whole table and reports need the
whole table, so they are refused with a clear error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


class NotStreamable(ValueError):
    pass


def check_streamable(fitted) -> None:
    ordered = [s.column for s in fitted.fill_plan.steps if s.kind in ("forward_fill", "backward_fill")]
    if ordered:
        raise NotStreamable(f"ordered fills need the whole table and cannot run on a stream: {ordered}")


def prepare_stream(fitted, stream: DataFrame) -> DataFrame:
    """The fitted preparation applied to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    check_streamable(fitted)
    return fitted.transform(stream)


def run_stream_once(fitted, stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet"):
    """Process everything available now and stop (``trigger(availableNow=True)``); returns the query."""
    q = (prepare_stream(fitted, stream).writeStream.format(fmt).option("checkpointLocation", checkpoint)
         .option("path", sink_path).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
