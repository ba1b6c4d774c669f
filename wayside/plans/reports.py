"""Queries of error metrics, audits and models over orders and line items, and of dedup and order elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, models, ordering
from .registry import BASE, DAY, events, query, table
from .streams import r6

#: Runs are suppliers, groups are return flags; the estimate is a price without tax knowledge.
_ERR = """WITH e AS (SELECT l_suppkey AS run_id, l_returnflag AS part, l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS truth,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS estimate, l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice AS error FROM lineitem)
"""


def errors(spark: SparkSession, d: str) -> DataFrame:
    estimate = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("part"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("truth"), estimate.alias("estimate"), (estimate - F.col("l_extendedprice")).alias("error"))


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(_ERR + "SELECT run_id, count(error)::BIGINT AS n, 0::BIGINT AS nonfinite, round(sqrt(avg(error * error)), 4) AS rmse, round(max(abs(error)), 4) AS max_abs, round(avg(error), 4) AS bias FROM e GROUP BY run_id")
def err_metric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.error_metric(errors(spark, d), ["run_id"]), "rmse", "max_abs", "bias")


@query(
    """WITH v AS (SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS q, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_tax * 100 - 4 AS z FROM lineitem),
n AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM v)
SELECT run_id, count(*)::BIGINT AS n, round(sum(r * r), 4) AS sse, round(sum(r), 4) AS sae, round(avg(x), 4) AS bias_x, round(avg(y), 4) AS bias_y, round(avg(z), 4) AS bias_z,
  round(sqrt(avg(r * r)), 4) AS rmse, round(avg(r), 4) AS mae, round(quantile_cont(r, 0.95), 4) AS p95, round(max(r), 4) AS max_norm, round(max_by(r, q), 4) AS endpoint FROM n GROUP BY run_id"""
)
def vec_err_sums(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("q"), (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100 - 5).alias("y"), (F.col("l_tax") * 100 - 4).alias("z"))
    found = aggregates.vector_sums(v, ["run_id"], ["x", "y", "z"], "q")
    return rounded(found, *(c for c in found.columns if c not in ("run_id", "n")))


@query(
    """WITH b AS (SELECT user_id AS run_id, epoch_us(ts) AS t, value AS truth, CASE WHEN event_type <> 'error' THEN value + json_extract(props, '$.k')::INT / 100.0 - 0.5 END AS est FROM events),
e AS (SELECT *, est - truth AS e, t - lag(t) OVER w AS dt FROM b WINDOW w AS (PARTITION BY run_id ORDER BY t)),
c AS (SELECT *, CASE WHEN e IS NOT NULL AND lag(e) OVER w IS NOT NULL AND dt > 0 AND dt < 172800000000 THEN dt / 1e6 END AS cov, lag(e) OVER w AS pe FROM e WINDOW w AS (PARTITION BY run_id ORDER BY t))
SELECT run_id, count(e)::BIGINT AS n, round(count(e) / count(*), 4) AS coverage, round(sum(e * e), 4) AS sse, round(sum(abs(e)), 4) AS sae, round(sum(e), 4) + 0.0 AS se, round(sqrt(avg(e * e)), 4) AS rmse,
  round(avg(abs(e)), 4) AS mae, round(avg(e), 4) + 0.0 AS bias, round(quantile_cont(abs(e), 0.95), 4) AS p95, round(quantile_cont(abs(e), 0.99), 4) AS p99,
  round(coalesce(sum((e + pe) / 2 * cov), 0), 2) + 0.0 AS covered_integral_error, round(coalesce(sum(cov), 0), 2) AS covered_seconds,
  round(sqrt(avg(e * e) FILTER (WHERE truth > 10)), 4) AS moving_rmse, round(sqrt(avg(e * e) FILTER (WHERE truth < 1)), 4) AS stopped_rmse FROM c GROUP BY run_id"""
)
def speed_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("estimate", F.when(F.col("channel") != "error", F.col("value") + F.col("k") / 100 - 0.5))
    found = aggregates.speed_metrics(e, ["run_id"], "arrival", "value", "estimate", 10.0, 1.0, 2 * DAY)
    return rounded(rounded(found, *(c for c in found.columns if c not in ("run_id", "n", "covered_integral_error", "covered_seconds"))), "covered_integral_error", "covered_seconds", digits=2)


_PER_RUN = ", r AS (SELECT run_id, part, count(*)::BIGINT AS n, sum(error * error) AS sse, sqrt(avg(error * error)) AS rmse FROM e GROUP BY run_id, part) "


@query(_ERR + _PER_RUN + "SELECT part, count(*)::BIGINT AS runs, sum(n)::BIGINT AS n, round(sqrt(sum(sse) / sum(n)), 4) AS pooled_rmse, round(avg(rmse), 4) AS macro_rmse, round(max(rmse), 4) AS worst_rmse FROM r GROUP BY part")
def pooled_macro_worst(spark: SparkSession, d: str) -> DataFrame:
    per = errors(spark, d).groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error") * F.col("error")).alias("sse"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    return rounded(aggregates.pooled(per, ["part"]), "pooled_rmse", "macro_rmse", "worst_rmse")


@query(_ERR + "SELECT part, l_linenumber AS line, count(*)::BIGINT AS n, round(avg(error), 4) AS bias FROM e GROUP BY GROUPING SETS ((), (part), (part, l_linenumber))")
def grouping_sets_vehicle(spark: SparkSession, d: str) -> DataFrame:
    e = errors(spark, d).withColumnRenamed("l_linenumber", "line")
    return aggregates.grouping_sets(e, [[], ["part"], ["part", "line"]], {"n": F.count(F.lit(1)), "bias": F.round(F.avg("error"), 4)})


@query("SELECT l_returnflag AS part, round(quantile_cont(l_extendedprice, 0), 4) AS q0, round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99, round(quantile_cont(l_extendedprice, 1), 4) AS q100 FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"q0": 0.0, "q01": 0.01, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    return rounded(aggregates.quantiles(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "part"), ["part"], "l_extendedprice", shares), *shares)


@query(
    BASE
    + """SELECT run_id, channel, count(*)::BIGINT AS n, min(header) AS first_header, max(header) AS last_header, (max(arrival) - min(arrival)) / 1e6 AS arrival_seconds, quantile_cont((arrival - header) / 1e6, 0.5) AS delay_median,
  round(quantile_cont((arrival - header) / 1e6, 0.99), 3) AS delay_p99, sum(late)::BIGINT AS not_increasing, min(value) AS least, max(value) AS most
FROM (SELECT *, coalesce((header <= lag(header) OVER (PARTITION BY run_id, channel ORDER BY arrival, id))::INT, 0) AS late FROM base) GROUP BY run_id, channel"""
)
def topic_audit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.topic_audit(events(spark, d), ["run_id", "channel"]), "delay_p99", digits=3)


@query(
    BASE
    + """, p AS (SELECT p.run_id, p.id, max(c.header) AS h FROM base p LEFT JOIN kept c ON c.run_id = p.run_id AND c.channel = 'click' AND c.arrival <= p.arrival AND c.header <= p.header WHERE p.channel = 'purchase' GROUP BY ALL)
SELECT count(*)::BIGINT AS asked, count(h)::BIGINT AS answered, round(count(h) / count(*), 6) AS coverage, round((SELECT count(*) FROM kept) / (SELECT count(*) FROM base), 6) AS accepted FROM p"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import joins
    from .streams import kept

    met = joins.asof_dual_clock(events(spark, d, "purchase"), kept(spark, d, "click"), ["run_id"])
    asked = met.agg(F.count(F.lit(1)).alias("asked"), F.count("r_header").alias("answered"))
    marked = ordering.record_high(events(spark, d), ["run_id", "channel"]).agg(F.count(F.lit(1)).alias("kept"))
    every = events(spark, d).agg(F.count(F.lit(1)).alias("every"))
    one = asked.withColumn("i", F.lit(1)).join(marked.withColumn("i", F.lit(1)), "i").join(every.withColumn("i", F.lit(1)), "i")
    return one.select("asked", "answered", F.round(F.col("answered") / F.col("asked"), 6).alias("coverage"), F.round(F.col("kept") / F.col("every"), 6).alias("accepted"))


@query("SELECT p_brand AS brand, floor(p_size / 5)::BIGINT AS bin, round(median(p_retailprice), 4) AS median, count(*)::BIGINT AS n FROM part GROUP BY 1, 2")
def binned_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.binned_median(table(spark, d, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_size", "p_retailprice", 5), "median")


@query("WITH m AS (SELECT median(l_extendedprice / l_quantity) AS m FROM lineitem GROUP BY l_suppkey) SELECT count(*)::BIGINT AS runs, round(quantile_cont(m, 0.25), 4) AS q25, round(quantile_cont(m, 0.5), 4) AS factor, round(quantile_cont(m, 0.75), 4) AS q75 FROM m")
def scale_nested_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("f"))
    return rounded(aggregates.median_of_medians(rows, "l_suppkey", "f"), "q25", "factor", "q75")


@query(BASE + ", f AS (SELECT run_id, (CASE WHEN k > 50 THEN 8 ELSE 0 END) | (CASE WHEN value > 20 THEN 4 ELSE 0 END) AS flags FROM base) SELECT run_id, count(*)::BIGINT AS n, round(avg((flags & 8 <> 0)::INT), 6) AS not_initialized, round(avg((flags & 4 <> 0)::INT), 6) AS outside_map FROM f GROUP BY run_id")
def flag_shares(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d).withColumn("flags", F.when(F.col("k") > 50, 8).otherwise(0).bitwiseOR(F.when(F.col("value") > 20, 4).otherwise(0)))
    return rounded(aggregates.flag_shares(f, ["run_id"], {"not_initialized": 8, "outside_map": 4}), "not_initialized", "outside_map", digits=6)


@query(
    BASE
    + """, l AS (SELECT run_id, arrival, CASE WHEN channel <> 'error' THEN k / 400.0 END AS latency FROM base), s AS (SELECT run_id, round(count(latency) / count(*), 6) AS coverage, round(quantile_cont(latency, 0.99), 6) AS p99, max(latency) AS most,
  (count(latency) - 1) / ((max(arrival) - min(arrival)) / 1e6) AS hertz FROM l GROUP BY run_id)
SELECT run_id, coverage, p99, round(most, 6) AS most, round(hertz, 9) AS hertz, coverage >= 0.995 AS coverage_ok, coalesce(p99 <= 0.1, false) AS p99_ok, coalesce(most <= 0.25, false) AS most_ok, coalesce(hertz >= 0.000002, false) AS hertz_ok FROM s"""
)
def service_levels(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("latency", F.when(F.col("channel") != "error", F.col("k") / 400)).withColumn("asked", F.lit(1))
    return rounded(rounded(aggregates.service_levels(e, ["run_id"], time="arrival", hertz=0.000002), "coverage", "p99", "most", digits=6), "hertz", digits=9)


@query(
    _ERR
    + """, g AS (SELECT part, sum(error * error) AS a, sum((error / 2) * (error / 2)) AS b, count(*) AS n FROM e GROUP BY part)
SELECT round(sqrt(sum(a) / sum(n)), 4) AS pooled_old, round(sqrt(sum(b) / sum(n)), 4) AS pooled_new, round(max(sqrt(b / n) / sqrt(a / n) - 1), 6) AS worst_change,
  1 - sqrt(sum(b) / sum(a)) >= 0.05 AND max(sqrt(b / n) / sqrt(a / n) - 1) <= 0.05 AS accepted FROM g"""
)
def candidate_gate(spark: SparkSession, d: str) -> DataFrame:
    e = errors(spark, d)
    per = e.groupBy("part", "run_id").agg(F.sum(F.col("error") * F.col("error")).alias("a"), F.sum(F.col("error") / 2 * F.col("error") / 2).alias("b"), F.count(F.lit(1)).alias("n"))
    return rounded(rounded(aggregates.better(per, "part", "a", "b"), "pooled_old", "pooled_new"), "worst_change", digits=6)


@query("SELECT doc_id, sha256(text) AS sha256, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS kept, min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate_of FROM documents")
def dedup_content(spark: SparkSession, d: str) -> DataFrame:
    return ordering.first_content(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha256", "kept", "duplicate_of")


@query("SELECT l_suppkey AS run_id, count(*)::BIGINT AS n, round(sqrt(avg((l_discount * 100 - 5) * (l_discount * 100 - 5))), 4) AS rmse FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 GROUP BY 1 HAVING count(*) >= 20 AND sqrt(avg((l_discount * 100 - 5) * (l_discount * 100 - 5))) < 3.2")
def eligible_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), "l_quantity", (F.col("l_discount") * 100 - 5).alias("e"))
    return rounded(models.eligible(rows, "run_id", "e", "l_quantity", 10, 30, 20, 3.2), "rmse")


@query(
    """WITH r AS (SELECT l_suppkey AS run_id, l_partkey % 40 * 25 + l_quantity AS place, abs(l_discount * 100 - 5) AS error, 1 - l_tax / 2 AS cosine FROM lineitem),
g AS (SELECT *, cosine > 0.975 AND error < 5 AND ((place > 0 + 50 AND place < 400 - 50) OR (place > 600 + 50 AND place < 900 - 50)) AS central,
  cosine > 0.975 AND error < 5 AND (place - 700) - 1000 * floor((place - 700) / 1000) BETWEEN 430 AND 650 AS near FROM r),
s AS (SELECT run_id, count_if(central) AS central_count, sqrt(avg(error * error) FILTER (central)) AS central_rmse, count_if(near) AS near FROM g GROUP BY run_id)
SELECT run_id, central_count::BIGINT AS central_count, round(central_rmse, 4) AS central_rmse, CASE WHEN central_count >= 100 AND central_rmse < 2.4 THEN near ELSE 0 END::BIGINT AS local_count,
  CASE WHEN NOT coalesce(central_count >= 100 AND central_rmse < 2.4, false) THEN 'rejected' WHEN near = 0 THEN 'no_local_rows' ELSE 'eligible' END AS status FROM s"""
)
def central_support(spark: SparkSession, d: str) -> DataFrame:
    """Which suppliers' lines may teach a stretch of a loop of 1,000: by their own support elsewhere on it."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_partkey") % 40 * 25 + F.col("l_quantity")).alias("place"), F.abs(F.col("l_discount") * 100 - 5).alias("error"), (1 - F.col("l_tax") / 2).alias("cosine"))
    return rounded(models.support(rows, "run_id", "place", "error", "cosine", [(0.0, 400.0), (600.0, 900.0)], 50.0, (430.0, 650.0), 700.0, 1000.0, 100, 2.4, 0.975, 5.0), "central_rmse")


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, l_quantity + least(greatest(l_tax * 100 - 4, -1.5), 1.5)), 6) AS v FROM lineitem")
def clipped_candidate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(models.clipped_residual(F.col("l_quantity"), F.col("l_tax") * 100 - 4, 1.5)).alias("v"))


_TERMS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query()
def irls_huber(spark: SparkSession, d: str) -> DataFrame:
    beta = models.huber_irls(table(spark, d, "lineitem"), _TERMS, "l_extendedprice", "l_suppkey", scale=500.0)
    return spark.createDataFrame([(t, float(b)) for t, b in zip(_TERMS, beta, strict=True)], "term string, coefficient double")


@query()
def huber_ml(spark: SparkSession, d: str) -> DataFrame:
    model = models.fit_huber(table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double")), _TERMS, "l_extendedprice")
    return spark.createDataFrame([(t, float(b)) for t, b in zip(_TERMS, model.coefficients, strict=True)], "term string, coefficient double")


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double"))


@query()
def gbt_score(spark: SparkSession, d: str) -> DataFrame:
    """Each half of the orders is scored, from a node table, by trees fitted on the other half."""
    rows, scored = _priced(spark, d).withColumn("half", F.col("l_orderkey") % 2), None
    for k in (0, 1):
        groups = models.grouped(rows.where(F.col("half") != k), _TERMS, "l_extendedprice")
        nodes = models.node_table(models.fit_trees_grouped(groups, _TERMS, "l_extendedprice"))
        one = rows.where(F.col("half") == k).withColumn("predicted", models.score(nodes, [F.col(c) for c in _TERMS]))
        scored = one if scored is None else scored.unionByName(one)
    return aggregates.error_metric(scored.withColumn("error", F.col("predicted") - F.col("l_extendedprice")), ["l_returnflag"])


@query("SELECT l_returnflag, count(*)::BIGINT AS n, true AS exact FROM lineitem GROUP BY 1")
def tree_export(spark: SparkSession, d: str) -> DataFrame:
    """The node table gives what the fitted model gives, to 1e-10 of it, on every row."""
    # Every row is read once; what trees make of it hangs on its features alone, of which there are some ten thousand.
    flags = models.grouped(_priced(spark, d), _TERMS, "l_extendedprice", ("l_returnflag",)).persist()
    groups = flags.groupBy(*_TERMS).agg(*(F.sum(c).alias(c) for c in ("l_extendedprice", "known")))
    model = models.fit_trees_grouped(groups, _TERMS, "l_extendedprice", trees=20)
    gaps = models.export_gap(model, models.node_table(model), flags, _TERMS, ["l_returnflag"], "n")
    return gaps.select("l_returnflag", "n", (F.col("gap") < 1e-10).alias("exact"))
