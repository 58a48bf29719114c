"""An extra beside the batch operators: the dense-window count as a stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, late: str = "10 minutes", width: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """events (source, ts): counts by source and sliding window; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "source").agg(F.count(F.lit(1)).alias("n")).select("source", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
