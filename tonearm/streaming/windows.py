"""Event-time windows over live tables; the same functions take tables that are at rest.

State is bounded by the watermark: what is later than it is dropped, and a window goes out once when the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N


def report_windows(reports: DataFrame, key: str, at: str, length: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Loss, jitter and round trip of each stream's receiver reports by window, with the quality level."""
    out = reports.withWatermark(at, late).groupBy(key, F.window(at, length).alias("w")).agg(
        F.count("*").alias("reports"), (F.sum("fraction_lost") * 100.0 / (F.count("*") * 256.0)).alias("loss"), N.idiv(F.sum("jitter_us"), F.count("*")).alias("jitter_us"),
        F.max("jitter_us").alias("max_jitter_us"), N.idiv(F.sum("rtt_us"), F.count("rtt_us")).alias("rtt_us"),
    )
    level = N.quality_level(F.col("loss"), F.col("max_jitter_us"), F.col("rtt_us"))
    return out.select(key, F.col("w.start").alias("start"), "reports", "loss", "jitter_us", "max_jitter_us", "rtt_us", level.alias("level"))


def first_requests(requests: DataFrame, key: str, at: str, within: str = "10 minutes") -> DataFrame:
    """One request for each key and span of time: the one that starts the transfer; the others follow it."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def session_spans(events: DataFrame, key: str, at: str, gap: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Spans of activity of each stream that no pause longer than ``gap`` cuts."""
    out = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
