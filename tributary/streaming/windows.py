"""The event-time windows as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.aggregate import micros


def _interval(duration: str) -> str:
    return f"{micros(duration)} microseconds"


def stream_window(df: DataFrame, event_time: str, window: dict, group_by: list[str], aggs: list, delay: str = "0s") -> DataFrame:
    """A windowed aggregate that emits a window once the watermark has passed it. Late rows are dropped by Spark, a batch at a time."""
    ((kind, spec),) = window.items()
    rows = df.where(F.col(event_time).isNotNull()).withColumn("_t", F.col(event_time).cast("timestamp")).withWatermark("_t", _interval(delay))
    if kind == "tumbling":
        w = F.window("_t", _interval(spec))
    elif kind == "hopping":
        w = F.window("_t", _interval(spec[0]), _interval(spec[1]))
    else:
        w = F.session_window("_t", _interval(spec))
    return rows.groupBy(w.alias("w"), *group_by).agg(*aggs).withColumn("window_start", F.col("w.start")).drop("w")
