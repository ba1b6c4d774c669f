"""Round trips through files: what is written and read again, against SQL over the tables it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rescore import rescore
from ..schema import PREDICTION_COLUMNS
from ..sources import manifests, runs, texts
from .maps import _RING, ring
from .registry import BASE, events, query, table
from .streaming import scratch
from .trips import replay

_KIND = {"click": "F", "view": "R", "purchase": "C", "signup": "G"}


@query(
    BASE
    + """SELECT CASE channel WHEN 'click' THEN 'F' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'G' ELSE 'X' END AS kind, header AS stamp, arrival,
CASE WHEN channel IN ('click', 'view') THEN value WHEN channel = 'purchase' THEN k END::DOUBLE AS value, CASE WHEN channel = 'signup' THEN value END AS lat, CASE WHEN channel = 'signup' THEN k END AS status FROM base"""
)
def event_text(spark: SparkSession, d: str) -> DataFrame:
    """Events as text lines among malformed ones, read back."""
    c = F.col("channel")
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in _KIND.items() for x in p))[c], F.lit("X"))
    fix = F.when(c == "signup", F.array("value", F.col("k").cast("double"), F.lit(0.0)))
    value = F.when(c == "purchase", F.col("k").cast("double")).otherwise(F.col("value"))
    rows = events(spark, d).select(kind.alias("kind"), F.col("header").alias("stamp"), "arrival", value.alias("value"), fix.alias("lla"), F.col("k").alias("status"))
    path = f"{scratch(spark, 'event-text')}/lines"
    damaged = [F.lit("F 1"), F.concat_ws(" ", F.lit("R"), "n_nationkey", F.lit("x"), F.lit("1.5")), F.lit("G 1 2 3.0 4.0"), F.lit("Q 1 2"), F.lit("")]
    broken = table(spark, d, "nation").select(F.explode(F.array(*damaged)).alias("value"))
    texts.event_lines(rows).unionByName(broken).write.text(path)
    return texts.read_events(spark.read.text(path)).select("kind", "stamp", "arrival", "value", F.col("lla")[0].alias("lat"), "status")


@query(_RING + "SELECT round(s, 6) AS s, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z FROM r")
def route_files(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark, 'route')}/route"
    texts.write_route(ring(spark, d).select("s", "x", "y", "z"), path)
    return texts.read_route(spark, path).select(*((F.round(c, 6) + 0).alias(c) for c in ("s", "x", "y", "z")))


@query(
    """WITH tick AS (SELECT s_suppkey AS k, i, 1.01 * (8 + 3 * sin(0.3 * i * 0.05 + s_suppkey)) AS v FROM supplier, range(600) t(i)),
step AS (SELECT k, i, coalesce((v + lag(v) OVER (PARTITION BY k ORDER BY i)) / 2 * 0.05, 0) AS w FROM tick), way AS (SELECT k, i, sum(w) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS distance FROM step)
SELECT 1700000000000000 + i * 50000 AS stamp, count(*)::BIGINT AS n, round(sum(distance), 2) AS distance FROM way GROUP BY 1"""
)
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of all trips as blank-separated text, read back with their 20 columns checked."""
    path = f"{scratch(spark, 'predictions')}/text"
    replay(spark, d).select(F.concat_ws(" ", *(F.col(c).cast("string") for c in PREDICTION_COLUMNS)).alias("value")).write.text(path)
    return texts.read_predictions(spark, path).groupBy("stamp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 2).alias("distance"))


@query(BASE + "SELECT id, CASE WHEN k <= 90 THEN value END AS value FROM base")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """A report whose numbers are sometimes none; as JSON they are null."""
    path = f"{scratch(spark, 'report')}/report"
    rows = events(spark, d).select("id", F.when(F.col("k") > 90, float("nan")).otherwise(F.col("value")).alias("value"))
    texts.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT user_id AS run_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def cached_runs(spark: SparkSession, d: str) -> DataFrame:
    """All runs kept as Parquet, and those of one part of a manifest read again."""
    path = f"{scratch(spark, 'runs')}/runs"
    runs.save(events(spark, d), path, "run_id", "arrival")
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("run_id"))
    return runs.load_like(spark, path, "run_id", wanted).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("part"))


@query("SELECT event_id AS id, user_id AS run_id FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'MACHINERY'")
def part_rows(spark: SparkSession, d: str) -> DataFrame:
    return manifests.of_part(events(spark, d), _manifest(spark, d), "MACHINERY").select("id", "run_id")


@query("SELECT DISTINCT user_id AS run_id FROM events WHERE value > 220")
def strange_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose content is not what the manifest names: some of their values changed since."""
    e = events(spark, d)
    changed = e.withColumn("value", F.when(F.col("value") > 220, F.col("value") + 1).otherwise(F.col("value")))
    return manifests.strangers(manifests.fingerprint(changed, ["run_id"]), manifests.fingerprint(e, ["run_id"])).select("run_id")


@query(
    BASE
    + """SELECT run_id, count_if(channel <> 'purchase' OR k <= 10)::BIGINT AS unscored, nullif(count_if(channel = 'purchase' AND k > 10), 0)::BIGINT AS n,
round(sqrt(avg((value - k) * (value - k)) FILTER (channel = 'purchase' AND k > 10)), 6) AS rmse, round(avg(value - k) FILTER (channel = 'purchase' AND k > 10), 6) AS bias FROM base GROUP BY run_id"""
)
def rescored(spark: SparkSession, d: str) -> DataFrame:
    """Saved predictions scored again against another truth, which some of them lack."""
    folder = scratch(spark, "rescored")
    events(spark, d).select("run_id", "id", F.col("value").alias("prediction")).write.parquet(f"{folder}/saved")
    truth = events(spark, d, "purchase").where("k > 10").select("id", F.col("k").cast("double").alias("truth"))
    rescore(spark.read.parquet(f"{folder}/saved"), truth, ["id"], ["run_id"], folder)
    report = spark.read.schema("run_id long, unscored long, n long, rmse double, bias double").json(f"{folder}/report")
    return report.select("run_id", "unscored", "n", F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias"))
