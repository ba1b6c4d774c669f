"""Runs kept as Parquet, so that a few of them can be read again without a scan of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def save(rows: DataFrame, path: str, run: str, time: str) -> None:
    """One folder a bucket of runs, rows in order of run and time; what is there already stays.

    Ranges, not buckets, are dealt to the tasks, so a run with many rows is written by several.
    """
    kept = rows.withColumn("bucket", _bucket(F.col(run)))
    kept.repartitionByRange("bucket", run, time).sortWithinPartitions("bucket", run, time).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, run: str, wanted: list | None = None) -> DataFrame:
    """All runs, or the wanted ones: only their folders are listed, and of those only row groups that may hold them."""
    rows = spark.read.parquet(path)
    if wanted is not None:
        kind = rows.schema[run].dataType
        rows = rows.where(F.col("bucket").isin(*(_bucket(F.lit(w).cast(kind)) for w in wanted)) & F.col(run).isin(*wanted)) if wanted else rows.limit(0)
    return rows.drop("bucket")


def load_like(spark: SparkSession, path: str, run: str, wanted: DataFrame) -> DataFrame:
    """The runs that a table of any size names; buckets are part of the join, so folders are pruned as it runs."""
    keys = wanted.select(run, _bucket(F.col(run)).alias("bucket")).distinct()
    return spark.read.parquet(path).join(keys, ["bucket", run], "left_semi").drop("bucket")
