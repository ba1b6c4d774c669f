"""Order of two-clock event streams: arrival decides what is seen first, headers when it was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_high(events: DataFrame, by: list[str], header: str = "header", order: tuple[str, ...] = ("arrival", "id")) -> DataFrame:
    """Rows whose header exceeds every header seen before them in arrival order.

    The first row of each key stays; repeated and late headers go; nothing is re-sorted.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_prior", F.max(header).over(before)).where(F.col("_prior").isNull() | (F.col(header) > F.col("_prior"))).drop("_prior")


def merge(channels: list[DataFrame], run: str = "run_id", order: tuple[str, ...] = ("arrival", "id")) -> DataFrame:
    """Channels as one stream, each run in one partition and in arrival order there."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)
    return every.repartition(run).sortWithinPartitions(run, *order)


def sub_runs(events: DataFrame, by: list[str], clock: str = "header", order: tuple[str, ...] = ("arrival", "id")) -> DataFrame:
    """sub_run: counts how often the clock went backwards, so that state starts anew there."""
    w = Window.partitionBy(*by).orderBy(*order)
    back = F.coalesce((F.col(clock) < F.lag(clock).over(w)).cast("int"), F.lit(0))
    return events.withColumn("_back", back).withColumn("sub_run", F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_back")


def every_nth(events: DataFrame, by: list[str], n: int, order: tuple[str, ...]) -> DataFrame:
    """Each n-th row of a key in order, from the first on."""
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % n == 0).drop("_n")


def first_content(files: DataFrame, content: str, path: str) -> DataFrame:
    """sha256 of each content, whether it is the first path that holds it, and which one is."""
    hashed = files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    # Sums before the shuffle, so a content that stands in a third of all files is one row a task.
    least = hashed.groupBy("sha256").agg(F.min(path).alias("duplicate_of"))
    return hashed.join(least, "sha256").withColumn("kept", F.col(path) == F.col("duplicate_of"))


def timer_grid(events: DataFrame, run: str, stamp: str, step: int) -> DataFrame:
    """A row at every ``step`` from a run's first to its last stamp: the ticks of a timer."""
    span = events.groupBy(run).agg(F.min(stamp).alias("lo"), F.max(stamp).alias("hi"))
    return span.select(run, F.explode(F.sequence("lo", "hi", F.lit(step))).alias("tick"))


def gap_islands(stamp: str, by: list[str], gap: int) -> tuple[Column, Window]:
    """1 where a row begins a burst (more than ``gap`` after the one before), and the window to sum it over."""
    w = Window.partitionBy(*by).orderBy(stamp)
    begins = F.when(F.col(stamp) - F.lag(stamp).over(w) > gap, 1).otherwise(0)
    return begins, w.rowsBetween(Window.unboundedPreceding, 0)


def prefix(rows: DataFrame, cuts: DataFrame, run: str, time: str) -> DataFrame:
    """What was known at each run's ``cut``: its rows with a time up to then; runs without a cut have none."""
    return rows.join(cuts.select(run, F.col("cut").alias("_cut")), run).where(F.col(time) <= F.col("_cut")).drop("_cut")
