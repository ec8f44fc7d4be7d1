"""aggregate_calls on a stream: calls are deduplicated within the watermark, then summed by site and event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate_calls_stream(calls: DataFrame, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """n_called, sum_p and n_mod by site and window; a read's repeated call at a site counts once, in the window it first
    came in. Works on streams and on tables."""
    d = calls.withWatermark(time, late).dropDuplicatesWithinWatermark(["read_id", "contig", "pos", "strand"]) if calls.isStreaming else calls.dropDuplicates(["read_id", "contig", "pos", "strand"])
    g = d.groupBy(F.window(time, window).alias("w"), "contig", "pos", "strand")
    return g.agg(F.count("*").alias("n_called"), F.sum("prob").alias("sum_p"), F.count_if(F.col("prob") > 0.5).alias("n_mod"))
