"""Registered queries, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster's checkpoints go, or a local one where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wayside-')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)  # when the application ends
    return path


def events(spark: SparkSession, sf_dir: str, *channels: str) -> DataFrame:
    """The events as a two-clock stream: users are runs, types are channels, headers lag arrivals by hours."""
    e = table(spark, sf_dir, "events")
    if channels:
        e = e.where(F.col("event_type").isin(*channels))
    arrival = F.unix_micros(F.col("ts").cast("timestamp"))
    lag = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("channel"), arrival.alias("arrival"), (arrival - lag * HOUR).alias("header"), "value", lag.cast("int").alias("k"))


#: The same in DuckDB: base (all events) and kept (record-high by run and channel).
BASE = """WITH base AS (SELECT event_id AS id, user_id AS run_id, event_type AS channel, epoch_us(ts) AS arrival,
  epoch_us(ts) - json_extract(props, '$.k')::BIGINT * 3600000000 AS header, value, json_extract(props, '$.k')::INT AS k FROM events),
kept AS (SELECT * EXCLUDE prior FROM (SELECT *, max(header) OVER (PARTITION BY run_id, channel ORDER BY arrival, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM base)
  WHERE prior IS NULL OR header > prior)
"""
