"""Event-time windows of streams, by Spark's watermarks and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, length: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums of fixed windows; rows later than ``late`` are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, length), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("begins"), "n", "total")


def sliding(stream: DataFrame, time: str, length: str, slide: str, late: str, by: list[str]) -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.window(time, length, slide), *by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("window.start").alias("begins"), "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Bursts: windows that end when nothing has come for ``gap``."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("session_window.start").alias("begins"), "n")
