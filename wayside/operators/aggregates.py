"""Error metrics and audits: sums that pool, and what is read off them.

Partial sums go before the shuffle everywhere; exact percentiles are asked for only where the
reports are defined by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def error_metric(rows: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """n, nonfinite, rmse, max_abs (0 if there is none) and bias of an error column."""
    e = F.when(finite(F.col(error)), F.col(error))
    return rows.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.count_if(~finite(F.col(error))).alias("nonfinite"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.coalesce(F.max(F.abs(e)), F.lit(0.0)).alias("max_abs"),
        F.avg(e).alias("bias"),
    )


def vector_sums(rows: DataFrame, by: list[str], axes: list[str], order: str) -> DataFrame:
    """Sums, percentile and endpoint of error vectors, with the bias of each axis."""
    norm = F.sqrt(reduce(lambda a, b: a + b, (F.col(a) * F.col(a) for a in axes)))
    return rows.withColumn("_norm", norm).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_norm") * F.col("_norm")).alias("sse"),
        F.sum("_norm").alias("sae"),
        *(F.avg(a).alias(f"bias_{a}") for a in axes),
        F.sqrt(F.avg(F.col("_norm") * F.col("_norm"))).alias("rmse"),
        F.avg("_norm").alias("mae"),
        F.percentile("_norm", F.lit(0.95)).alias("p95"),
        F.max("_norm").alias("max_norm"),
        F.max_by("_norm", order).alias("endpoint"),
    )


def speed_metrics(rows: DataFrame, by: list[str], time: str, truth: str, estimate: str, moving: float, stopped: float, longest: int, unit: int = 1_000_000) -> DataFrame:
    """Pooled sums and shares of speed errors; rows without an estimate lower the coverage.

    covered_seconds and covered_integral_error: over steps of less than ``longest`` between
    rows that both have an estimate.
    """
    w = Window.partitionBy(*by).orderBy(time)
    e = F.when(finite(F.col(estimate)) & finite(F.col(truth)), F.col(estimate) - F.col(truth))
    step = F.col(time) - F.lag(time).over(w)
    covered = F.col("_e").isNotNull() & F.lag("_e").over(w).isNotNull() & (step > 0) & (step < longest)
    marked = rows.withColumn("_e", e).withColumn("_dt", F.when(covered, step / unit)).withColumn("_area", F.when(covered, (F.col("_e") + F.lag("_e").over(w)) / 2 * step / unit))
    square = F.col("_e") * F.col("_e")
    return marked.groupBy(*by).agg(
        F.count("_e").alias("n"),
        (F.count("_e") / F.count(F.lit(1))).alias("coverage"),
        F.sum(square).alias("sse"),
        F.sum(F.abs("_e")).alias("sae"),
        F.sum("_e").alias("se"),
        F.sqrt(F.avg(square)).alias("rmse"),
        F.avg(F.abs("_e")).alias("mae"),
        F.avg("_e").alias("bias"),
        F.percentile(F.abs("_e"), F.lit(0.95)).alias("p95"),
        F.percentile(F.abs("_e"), F.lit(0.99)).alias("p99"),
        F.coalesce(F.sum("_area"), F.lit(0.0)).alias("covered_integral_error"),
        F.coalesce(F.sum("_dt"), F.lit(0.0)).alias("covered_seconds"),
        F.sqrt(F.avg(F.when(F.col(truth) > moving, square))).alias("moving_rmse"),
        F.sqrt(F.avg(F.when(F.col(truth) < stopped, square))).alias("stopped_rmse"),
    )


def pooled(per_run: DataFrame, by: list[str]) -> DataFrame:
    """Pooled, macro and worst rmse over runs that each have n, sse and rmse."""
    return per_run.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"), F.sqrt(F.sum("sse") / F.sum("n")).alias("pooled_rmse"), F.avg("rmse").alias("macro_rmse"), F.max("rmse").alias("worst_rmse"))


def grouping_sets(rows: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """One pass over several groupings; columns outside a grouping are null there."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(*(m.alias(k) for k, m in measures.items()))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles as one column each."""
    found = rows.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(s) for s in shares.values()))).alias("_q"))
    return found.select(*by, *(F.col("_q")[i].alias(k) for i, k in enumerate(shares)))


def topic_audit(events: DataFrame, by: list[str], header: str = "header", arrival: str = "arrival", value: str = "value", unit: int = 1_000_000) -> DataFrame:
    """Counts, spans, delays and headers out of order of each channel."""
    w = Window.partitionBy(*by).orderBy(arrival, "id")
    late = F.coalesce((F.col(header) <= F.lag(header).over(w)).cast("long"), F.lit(0).cast("long"))
    delay = (F.col(arrival) - F.col(header)) / unit
    return events.withColumn("_late", late).withColumn("_delay", delay).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(header).alias("first_header"),
        F.max(header).alias("last_header"),
        ((F.max(arrival) - F.min(arrival)) / unit).alias("arrival_seconds"),
        F.percentile("_delay", F.lit(0.5)).alias("delay_median"),
        F.percentile("_delay", F.lit(0.99)).alias("delay_p99"),
        F.sum("_late").alias("not_increasing"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def binned_median(rows: DataFrame, by: list[str], place: str, value: str, width: float) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.col(place) / width)).groupBy(*by, "bin").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))


def median_of_medians(rows: DataFrame, run: str, value: str) -> DataFrame:
    """The median and quartiles over runs of each run's median: a factor no long run dominates."""
    per = rows.groupBy(run).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("runs"), *(F.percentile("m", F.lit(q)).alias(k) for k, q in (("q25", 0.25), ("factor", 0.5), ("q75", 0.75))))


def flag_shares(rows: DataFrame, by: list[str], flags: dict[str, int], column: str = "flags") -> DataFrame:
    """The share of rows in which each bit of a mask is set."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col(column).bitwiseAND(bit) != 0).cast("int")).alias(k) for k, bit in flags.items()))


def service_levels(latencies: DataFrame, by: list[str], latency: str = "latency", asked: str = "asked", p99: float = 0.1, most: float = 0.25, coverage: float = 0.995, hertz: float = 10.0, time: str = "t", unit: int = 1_000_000) -> DataFrame:
    """Coverage, rate and latency of each run with whether they meet their limits."""
    out = latencies.groupBy(*by).agg(
        (F.count(latency) / F.count(asked)).alias("coverage"),
        F.percentile(latency, F.lit(0.99)).alias("p99"),
        F.max(latency).alias("most"),
        ((F.count(latency) - 1) / ((F.max(time) - F.min(time)) / unit)).alias("hertz"),
    )
    return out.withColumns({"coverage_ok": F.col("coverage") >= coverage, "p99_ok": F.coalesce(F.col("p99") <= p99, F.lit(False)), "most_ok": F.coalesce(F.col("most") <= most, F.lit(False)), "hertz_ok": F.coalesce(F.col("hertz") >= hertz, F.lit(False))})


def better(per_run: DataFrame, group: str, old: str, new: str, gain: float = 0.05, loss: float = 0.05) -> DataFrame:
    """Whether a candidate passes: pooled at least ``gain`` better and no group ``loss`` worse.

    per_run: group, n, and the squared errors summed as sse of the old and the new one.
    """
    groups = per_run.groupBy(group).agg(F.sqrt(F.sum(old) / F.sum("n")).alias("a"), F.sqrt(F.sum(new) / F.sum("n")).alias("b"), F.sum(old).alias("sa"), F.sum(new).alias("sb"), F.sum("n").alias("n"))
    return groups.agg(
        F.sqrt(F.sum("sa") / F.sum("n")).alias("pooled_old"),
        F.sqrt(F.sum("sb") / F.sum("n")).alias("pooled_new"),
        F.max(F.col("b") / F.col("a") - 1).alias("worst_change"),
        ((1 - F.sqrt(F.sum("sb") / F.sum("sa")) >= gain) & (F.max(F.col("b") / F.col("a") - 1) <= loss)).alias("accepted"),
    )


def counters(events: DataFrame, by: list[str], time: str, tests: dict[str, Column]) -> DataFrame:
    """Running counts of conditions along each key."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({k: F.sum(F.when(c, 1).otherwise(0)).over(w) for k, c in tests.items()})
