"""Queries over the event stream: order, time joins, windows, features and observers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signals
from ..operators import aggregates, features, joins, observer, ordering, windows
from .registry import BASE, DAY, HOUR, events, query

KEY = ["run_id", "channel"]
SCALES = features.Scales(horizons=(6 * HOUR, DAY, 3 * DAY), most_age=864000.0, most_ahead=21600.0)


def kept(spark: SparkSession, d: str, *channels: str) -> DataFrame:
    return ordering.record_high(events(spark, d, *channels), KEY)


def r6(c: str | F.Column) -> F.Column:
    return F.round(c, 6)


@query(BASE + "SELECT run_id, channel, id, header, arrival FROM kept")
def record_high(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d).select("run_id", "channel", "id", "header", "arrival")


@query(BASE + "SELECT run_id, id, channel, row_number() OVER (PARTITION BY run_id ORDER BY arrival, id) AS place FROM base WHERE channel IN ('click', 'view', 'purchase')")
def arrival_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = ordering.merge([events(spark, d, c) for c in ("click", "view", "purchase")])
    return merged.select("run_id", "id", "channel", F.row_number().over(Window.partitionBy("run_id").orderBy("arrival", "id")).alias("place"))


@query(BASE + "SELECT run_id, id, sum(back) OVER (PARTITION BY run_id ORDER BY arrival, id)::BIGINT AS sub_run FROM (SELECT *, coalesce((header < lag(header) OVER (PARTITION BY run_id ORDER BY arrival, id))::INT, 0) AS back FROM base WHERE channel = 'click')")
def sub_runs(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sub_runs(events(spark, d, "click"), ["run_id"]).select("run_id", "id", "sub_run")


@query(BASE + "SELECT run_id, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival, id) AS n FROM base WHERE value > 10) WHERE (n - 1) % 5 = 0")
def every_fifth_survivor(spark: SparkSession, d: str) -> DataFrame:
    return ordering.every_nth(events(spark, d).where("value > 10"), ["run_id"], 5, ("arrival", "id")).select("run_id", "id")


@query(BASE + "SELECT run_id, count(*)::BIGINT AS ticks, max(tick) AS last_tick FROM (SELECT run_id, unnest(range(min(arrival), max(arrival) + 1, 86400000000)) AS tick FROM base GROUP BY run_id) GROUP BY run_id")
def timer_grid(spark: SparkSession, d: str) -> DataFrame:
    return ordering.timer_grid(events(spark, d), "run_id", "arrival", DAY).groupBy("run_id").agg(F.count(F.lit(1)).alias("ticks"), F.max("tick").alias("last_tick"))


_PURCHASES = "(SELECT * FROM base WHERE channel = 'purchase')"
_CLICKS = "(SELECT * FROM kept WHERE channel = 'click')"


@query(BASE + f"SELECT p.run_id, p.id, round(p.value, 6) AS value, c.header AS r_header, c.value AS r_value FROM {_PURCHASES} p ASOF LEFT JOIN {_CLICKS} c ON p.run_id = c.run_id AND p.arrival >= c.arrival")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    met = joins.asof_backward(events(spark, d, "purchase"), kept(spark, d, "click"), ["run_id"], "arrival", "arrival")
    return met.select("run_id", "id", r6("value").alias("value"), "r_header", "r_value")


@query(
    BASE
    + f"""SELECT p.run_id, p.id, max(c.header) AS r_header, max_by(c.value, c.header) AS r_value
FROM {_PURCHASES} p LEFT JOIN {_CLICKS} c ON p.run_id = c.run_id AND c.arrival <= p.arrival AND c.header <= p.header GROUP BY p.run_id, p.id"""
)
def asof_dual_clock(spark: SparkSession, d: str) -> DataFrame:
    return joins.asof_dual_clock(events(spark, d, "purchase"), kept(spark, d, "click"), ["run_id"]).select("run_id", "id", "r_header", "r_value")


@query(
    BASE
    + f"""SELECT run_id, id, r_header, r_value FROM (SELECT p.run_id, p.id, c.header AS r_header, c.value AS r_value,
  row_number() OVER (PARTITION BY p.run_id, p.id ORDER BY abs(c.header - p.header), c.header DESC) AS n
  FROM {_PURCHASES} p LEFT JOIN {_CLICKS} c ON p.run_id = c.run_id AND abs(c.header - p.header) <= 21600000000) WHERE n = 1"""
)
def nearest_tie_later(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest(events(spark, d, "purchase"), kept(spark, d, "click"), ["run_id"], "header", "header", 6 * HOUR).select("run_id", "id", "r_header", "r_value")


@query(
    BASE
    + """SELECT run_id, a_id, b_id, gap FROM (SELECT a.run_id, a.id AS a_id, b.id AS b_id, abs(a.header - b.header) AS gap,
  row_number() OVER (PARTITION BY a.run_id, a.header, a.id ORDER BY abs(a.header - b.header), b.header, b.id) AS n
  FROM kept a JOIN kept b ON a.run_id = b.run_id AND a.channel = 'signup' AND b.channel = 'error' AND abs(a.header - b.header) <= 86400000000) WHERE n = 1"""
)
def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = joins.band_pairs(kept(spark, d, "signup").drop("channel", "k"), kept(spark, d, "error").drop("channel", "k"), ["run_id"], "header", DAY)
    return pairs.select("run_id", "a_id", "b_id", F.abs(F.col("a_header") - F.col("b_header")).alias("gap"))


@query(
    BASE
    + f"""SELECT p.run_id, p.id, round(CASE WHEN b.header IS NULL THEN a.value WHEN a.header IS NULL OR a.header = b.header THEN b.value
  ELSE b.value + (a.value - b.value) * (p.header - b.header) / (a.header - b.header) END, 6) AS value_at
FROM {_PURCHASES} p ASOF LEFT JOIN {_CLICKS} b ON p.run_id = b.run_id AND p.header >= b.header ASOF LEFT JOIN {_CLICKS} a ON p.run_id = a.run_id AND p.header <= a.header"""
)
def interpolate_at(spark: SparkSession, d: str) -> DataFrame:
    met = joins.interpolate(events(spark, d, "purchase"), kept(spark, d, "click"), ["run_id"], "header", "header", "value")
    return met.select("run_id", "id", r6("value_at").alias("value_at"))


@query()
def approx_sync(spark: SparkSession, d: str) -> DataFrame:
    both = events(spark, d, "signup", "error").withColumn("side", (F.col("channel") == "error").cast("int")).withColumn("stamp", F.col("header"))
    return joins.approx_sync(both, "run_id", "side", 6 * HOUR)


@query()
def publication_syncs(spark: SparkSession, d: str) -> DataFrame:
    """Commands paired with two published quantities, each on its own and late by its latency."""
    e = events(spark, d, "purchase", "signup", "error").withColumn("kind", F.when(F.col("channel") == "purchase", "command").when(F.col("channel") == "signup", "velocity").otherwise("position"))
    return joins.publication_syncs(e.withColumn("stamp", F.col("header")), "run_id", 6 * HOUR, {"velocity": HOUR, "position": 2 * HOUR})


@query(
    BASE
    + """SELECT run_id, id, status, prediction FROM (SELECT c.run_id, c.id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN late THEN 'unordered' ELSE 'ok' END AS status, prediction
  FROM (SELECT *, header // 10800000000 AS stamp FROM base WHERE channel = 'purchase') c LEFT JOIN (SELECT run_id, stamp, count(*) AS n, bool_or(late) AS late, min(value) AS prediction FROM
    (SELECT *, coalesce(stamp < max(stamp) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM (SELECT *, header // 10800000000 AS stamp FROM base WHERE channel = 'view'))
    GROUP BY run_id, stamp) v ON c.run_id = v.run_id AND c.stamp = v.stamp)"""
)
def link_exact(spark: SparkSession, d: str) -> DataFrame:
    stamped = events(spark, d, "purchase", "view").withColumn("stamp", F.expr("header div 10800000000"))
    linked = joins.link_exact(stamped.where("channel = 'purchase'").drop("value"), stamped.where("channel = 'view'").select("run_id", "id", "stamp", "value"), ["run_id"])
    return linked.select("run_id", "id", "status", "prediction")


@query(BASE + "SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY header, channel_no, id) AS place FROM (SELECT *, (channel = 'error')::INT AS channel_no FROM base WHERE channel IN ('signup', 'error'))")
def merge_two_queues(spark: SparkSession, d: str) -> DataFrame:
    return joins.merge_two_queues(events(spark, d, "signup"), events(spark, d, "error"), ["run_id"], "header").select("run_id", "id", "place")


@query("SELECT event_id AS id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') AND event_type = 'purchase'")
def split_semi(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "purchase").join(events(spark, d, "signup").select("run_id").distinct(), "run_id", "left_semi").select("id")


@query("SELECT event_id AS id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.user_id = e.user_id AND s.ts < e.ts)")
def anti_guard(spark: SparkSession, d: str) -> DataFrame:
    first = events(spark, d, "purchase").groupBy("run_id").agg(F.min("arrival").alias("first"))
    errors = events(spark, d, "error")
    return errors.join(first, (errors.run_id == first.run_id) & (first["first"] < errors.arrival), "left_anti").select("id")


@query(BASE + f"SELECT count(*)::BIGINT AS compared, count(h)::BIGINT AS answered, 0::BIGINT AS mismatches FROM (SELECT p.id, max(c.header) AS h FROM {_PURCHASES} p LEFT JOIN {_CLICKS} c ON p.run_id = c.run_id AND c.arrival <= p.arrival AND c.header <= p.header GROUP BY p.run_id, p.id)")
def rerun_equality(spark: SparkSession, d: str) -> DataFrame:
    """The dual-clock join as two windows, and as an equi-join with a filter and a maximum: every key must agree."""
    asked, known = events(spark, d, "purchase"), kept(spark, d, "click")
    first = joins.asof_dual_clock(asked, known, ["run_id"]).select("run_id", "id", F.col("r_header").alias("h"))
    both = asked.select("run_id", "id", F.col("arrival").alias("a"), F.col("header").alias("b")).join(known.select("run_id", "arrival", "header"), "run_id", "left")
    second = both.groupBy("run_id", "id").agg(F.max(F.when((F.col("arrival") <= F.col("a")) & (F.col("header") <= F.col("b")), F.col("header"))).alias("h"))
    apart = joins.mismatches(first, second, ["run_id", "id"], ["h"]).agg(F.count(F.lit(1)).alias("mismatches")).withColumn("k", F.lit(1))
    return first.agg(F.count(F.lit(1)).alias("compared"), F.count("h").alias("answered")).withColumn("k", F.lit(1)).join(apart, "k").drop("k")


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "click")


_K = BASE + ", c AS (SELECT * FROM kept WHERE channel = 'click') "
_W = "OVER (PARTITION BY run_id ORDER BY header)"
_LIM = "greatest(-0.001, least(0.001, {}))"


@query(_K + f"SELECT run_id, id, round(CASE WHEN (header - lag(header) {_W}) / 1e6 > 1e-6 THEN {_LIM.format(f'(value - lag(value) {_W}) / ((header - lag(header) {_W}) / 1e6)')} ELSE 0 END, 9) AS slope FROM c")
def slope_short(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d).select("run_id", "id", F.round(windows.slope_short(["run_id"], "value", "header", 0.001), 9).alias("slope"))


def _lag_sql(column: str, horizon: int) -> str:
    return f"coalesce(last_value({column}) OVER (PARTITION BY run_id ORDER BY header RANGE BETWEEN UNBOUNDED PRECEDING AND {horizon} PRECEDING), first_value({column}) {_W})"


def _horizon(n: int, h: int) -> None:
    def lag(spark: SparkSession, d: str) -> DataFrame:
        return _windowed(spark, d).select("run_id", "id", windows.lag_horizon(["run_id"], "value", "header", h).alias("lagged"))

    def slope(spark: SparkSession, d: str) -> DataFrame:
        return _windowed(spark, d).select("run_id", "id", F.round(windows.slope_horizon(["run_id"], "value", "header", h, 0.001), 9).alias("slope"))

    def ahead(spark: SparkSession, d: str) -> DataFrame:
        s = windows.slope_horizon(["run_id"], "value", "header", h, 0.001)
        return _windowed(spark, d).select("run_id", "id", r6(windows.extrapolate(F.col("value"), (F.col("arrival") - F.col("header")) / 1_000_000, s, 21600.0)).alias("ahead"))

    slope_sql = f"CASE WHEN (header - {_lag_sql('header', h)}) / 1e6 > 1e-6 THEN {_LIM.format(f'''(value - {_lag_sql('value', h)}) / ((header - {_lag_sql('header', h)}) / 1e6)''')} ELSE 0 END"
    for name, f, sql in (
        ("lag_horizon", lag, f"SELECT run_id, id, {_lag_sql('value', h)} AS lagged FROM c"),
        ("slope_horizon", slope, f"SELECT run_id, id, round({slope_sql}, 9) AS slope FROM c"),
        ("extrapolate", ahead, f"SELECT run_id, id, round(greatest(0, value + least((arrival - header) / 1e6, 21600) * {slope_sql}), 6) AS ahead FROM c"),
    ):
        f.__name__ = f"{name}_{n}"
        query(_K + sql)(f)


for _n, _h in enumerate(SCALES.horizons, 1):
    _horizon(_n, _h)


def _ema_sql(tau: float) -> str:
    return f"""WITH RECURSIVE base AS (SELECT event_id AS id, user_id AS run_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'purchase'),
e AS (SELECT run_id, id, n, t, value AS y FROM base WHERE n = 1 UNION ALL
  SELECT b.run_id, b.id, b.n, b.t, e.y + (1 - exp(-((b.t - e.t) / 1e6) / {tau})) * (b.value - e.y) FROM e JOIN base b ON b.run_id = e.run_id AND b.n = e.n + 1)
SELECT run_id, id, round(y, 6) AS ema FROM e"""


def _ema(n: int, tau: float) -> None:
    def ema(spark: SparkSession, d: str) -> DataFrame:
        found = windows.ema(events(spark, d, "purchase"), "run_id", "value", "arrival", {"ema": tau})
        return found.select("run_id", "id", r6("ema").alias("ema"))

    ema.__name__ = f"ema_{n}"
    query(_ema_sql(tau))(ema)


for _n, _h in enumerate(SCALES.horizons, 1):
    _ema(_n, _h / 1e6)


@query(_K + f", p AS (SELECT *, coalesce((value + lag(value) {_W}) / 2 * (header - lag(header) {_W}) / 1e6, 0) AS part FROM c) SELECT run_id, id, round(sum(part) OVER (PARTITION BY run_id ORDER BY header ROWS UNBOUNDED PRECEDING), 3) AS distance FROM p")
def trapezoid_distance(spark: SparkSession, d: str) -> DataFrame:
    return windows.trapezoid(_windowed(spark, d), ["run_id"], "value", "header").select("run_id", "id", F.round("distance", 3).alias("distance"))


@query(BASE + ", n AS (SELECT * FROM (SELECT *, max(header) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM base WHERE channel = 'view') WHERE p IS NULL OR header > p) SELECT run_id, id, round((value - lag(value) OVER w) / ((header - lag(header) OVER w) / 1e6), 9) AS rate FROM n WINDOW w AS (PARTITION BY run_id ORDER BY arrival)")
def source_rate(spark: SparkSession, d: str) -> DataFrame:
    return windows.source_rate(events(spark, d, "view"), ["run_id"], "value", "header", "arrival").select("run_id", "id", F.round("rate", 9).alias("rate"))


@query(BASE + "SELECT run_id, id, coalesce(arrival - lag(arrival) OVER (PARTITION BY run_id ORDER BY arrival) > 86400000000, false) AS gap FROM base")
def gap_flag(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("run_id", "id", windows.gap_flag(["run_id"], "arrival", DAY).alias("gap"))


_BURSTS = BASE + ", g AS (SELECT *, coalesce(arrival - lag(arrival) OVER (PARTITION BY run_id ORDER BY arrival) > 43200000000, false)::INT AS new FROM base), b AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY arrival)::BIGINT AS burst FROM g) "


@query(_BURSTS + "SELECT run_id, burst, count(*)::BIGINT AS n, min(arrival) AS begins, max(arrival) AS ends FROM b GROUP BY run_id, burst")
def burst_segments(spark: SparkSession, d: str) -> DataFrame:
    b = windows.bursts(events(spark, d), ["run_id"], "arrival", 12 * HOUR)
    return b.groupBy("run_id", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("begins"), F.max("arrival").alias("ends"))


@query(_BURSTS + "SELECT run_id, id FROM b WHERE burst % 2 = 0")
def burst_parity_filter(spark: SparkSession, d: str) -> DataFrame:
    return windows.bursts(events(spark, d), ["run_id"], "arrival", 12 * HOUR).where("burst % 2 = 0").select("run_id", "id")


@query(BASE + "SELECT run_id, id FROM (SELECT *, (arrival - min(arrival) OVER (PARTITION BY run_id)) / 3.6e9 AS el FROM base) WHERE el <= 72 OR (el >= 100 AND (el - 100) % 168 < 24)")
def sparse_burst_filter(spark: SparkSession, d: str) -> DataFrame:
    elapsed = (F.col("arrival") - F.min("arrival").over(Window.partitionBy("run_id"))) / HOUR
    return events(spark, d).withColumn("el", elapsed).where(signals.sparse_burst(F.col("el"), 100.0, 72.0, 168.0, 24.0)).select("run_id", "id")


@query(
    """WITH RECURSIVE c AS (SELECT event_id AS id, user_id AS run_id, epoch_us(ts) AS t FROM events),
k AS (SELECT run_id, min(t) AS t FROM c GROUP BY run_id UNION ALL SELECT k.run_id, (SELECT min(c.t) FROM c WHERE c.run_id = k.run_id AND c.t >= k.t + 172800000000) AS t FROM k WHERE k.t IS NOT NULL)
SELECT c.run_id, c.id FROM k JOIN c ON c.run_id = k.run_id AND c.t = k.t"""
)
def greedy_spacing(spark: SparkSession, d: str) -> DataFrame:
    return windows.greedy_spacing(events(spark, d), "run_id", "arrival", 2 * DAY).select("run_id", "id")


@query(BASE + "SELECT run_id, id, least(count(*) OVER (PARTITION BY run_id ORDER BY arrival RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW), count(*) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))::BIGINT AS held FROM base")
def sliding_evidence(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(events(spark, d), ["run_id"], "arrival", 3 * DAY, 8).select("run_id", "id", "held")


@query(_K + "SELECT run_id, id, round(median(value) OVER (PARTITION BY run_id ORDER BY header ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM c")
def moving_median(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d).select("run_id", "id", r6(windows.moving_median(["run_id"], "value", "header")).alias("smooth"))


@query(
    _K
    + """, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id) AS m, first_value(value) OVER w AS a,
  last_value(value) OVER (PARTITION BY run_id ORDER BY header ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM c WINDOW w AS (PARTITION BY run_id ORDER BY header))
SELECT run_id, id, round((sum(value) OVER (PARTITION BY run_id ORDER BY header ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 3 - i) * a + greatest(0, 2 - (m - i)) * z) / 5, 6) AS smooth FROM n"""
)
def box_smooth(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d).select("run_id", "id", r6(windows.box_smooth(["run_id"], "value", "header")).alias("smooth"))


@query(_K + "SELECT run_id, id, count(*) OVER w = 3 AND min((value > 20)::INT) OVER w = 1 AS confirmed FROM c WINDOW w AS (PARTITION BY run_id ORDER BY header ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def confirm_three(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d).select("run_id", "id", windows.confirmed(["run_id"], F.col("value") > 20, "header").alias("confirmed"))


@query(
    _K
    + """SELECT run_id, id, round(CASE WHEN count(*) OVER w > 1 AND var_pop(k) OVER w > 1e-12 THEN covar_pop(value, k) OVER w / var_pop(k) OVER w END, 6) AS slope,
  round(avg(value) OVER w - CASE WHEN count(*) OVER w > 1 AND var_pop(k) OVER w > 1e-12 THEN covar_pop(value, k) OVER w / var_pop(k) OVER w END * avg(k) OVER w, 6) AS intercept
FROM c WINDOW w AS (PARTITION BY run_id ORDER BY header ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def window_regression(spark: SparkSession, d: str) -> DataFrame:
    found = windows.regression(_windowed(spark, d), ["run_id"], "k", "value", "header", 5)
    return found.select("run_id", "id", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(BASE + "SELECT run_id, id FROM (SELECT *, min(header) OVER (PARTITION BY run_id) AS f FROM base) WHERE header <= f + 259200000000 AND arrival <= f + 259200000000")
def init_window(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_window(events(spark, d), ["run_id"], "header", "arrival", 3 * DAY).select("run_id", "id")


@query(BASE + ", t AS (SELECT *, sum(value) OVER (PARTITION BY run_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS total FROM base) SELECT run_id, id, round(exp(-(total - first_value(total) OVER (PARTITION BY run_id ORDER BY arrival)) / 100), 9) AS part FROM t")
def bias_decay(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("arrival")
    t = events(spark, d).withColumn("total", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("run_id", "id", F.round(windows.decayed(F.col("total"), F.first("total").over(w), 100.0), 9).alias("part"))


@query(BASE + "SELECT run_id, id, sum((channel = 'error')::INT) OVER w::BIGINT AS errors, sum((value > 50)::INT) OVER w::BIGINT AS large FROM base WINDOW w AS (PARTITION BY run_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)")
def exposure_counters(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.counters(events(spark, d), ["run_id"], "arrival", {"errors": F.col("channel") == "error", "large": F.col("value") > 50}).select("run_id", "id", "errors", "large")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return features.rows(events(spark, d, "click"), events(spark, d, "view"), events(spark, d, "purchase"), SCALES)


_FEATURE_SQL = (
    BASE
    + """, q AS (SELECT * FROM kept WHERE channel = 'purchase'),
seen AS (SELECT q.run_id, q.id, w.channel, max(w.header) AS at FROM q JOIN kept w ON w.run_id = q.run_id AND w.channel IN ('click', 'view') AND w.arrival <= q.arrival AND w.header <= q.header GROUP BY ALL),
wheel AS (SELECT run_id, channel, header, value, lag AS lag_2, CASE WHEN dt > 1e-6 THEN greatest(-4, least(4, (value - v) / dt)) ELSE 0 END AS slope_1 FROM
  (SELECT *, (header - coalesce(last_value(header) OVER a, first_value(header) OVER f)) / 1e6 AS dt, coalesce(last_value(value) OVER a, first_value(value) OVER f) AS v, coalesce(last_value(value) OVER b, first_value(value) OVER f) AS lag
   FROM kept WHERE channel IN ('click', 'view') WINDOW a AS (PARTITION BY run_id, channel ORDER BY header RANGE BETWEEN UNBOUNDED PRECEDING AND 21600000000 PRECEDING), b AS (PARTITION BY run_id, channel ORDER BY header RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000000 PRECEDING), f AS (PARTITION BY run_id, channel ORDER BY header))),
known AS (SELECT seen.run_id, seen.id, seen.channel, seen.at, wheel.* EXCLUDE (run_id, channel, header) FROM seen JOIN wheel ON wheel.run_id = seen.run_id AND wheel.channel = seen.channel AND wheel.header = seen.at)
SELECT q.run_id, q.id, coalesce(f.value, 0) AS front, coalesce(r.value, 0) AS rear, round(least(coalesce((q.header - f.at) / 1e6, 864000), 864000), 6) AS front_age, round(least(coalesce((q.header - r.at) / 1e6, 864000), 864000), 6) AS rear_age,
  round(coalesce(f.slope_1, 0), 9) AS front_slope_1, coalesce(f.lag_2, 0) AS front_lag_2,
  round(greatest(0, coalesce(f.value, 0) + least(coalesce((q.header - f.at) / 1e6, 864000), 21600) * coalesce(f.slope_1, 0)), 6) AS front_ahead
FROM q LEFT JOIN known f ON f.run_id = q.run_id AND f.id = q.id AND f.channel = 'click' LEFT JOIN known r ON r.run_id = q.run_id AND r.id = q.id AND r.channel = 'view'"""
)


@query(_FEATURE_SQL)
def feature_row(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(spark, d).select("run_id", "id", "front", "rear", r6("front_age").alias("front_age"), r6("rear_age").alias("rear_age"), F.round("front_slope_1", 9).alias("front_slope_1"), "front_lag_2", r6("front_ahead").alias("front_ahead"))


def _full_feature_sql() -> str:
    """All 26 features: wheels by windows, the dual-clock join by conditions, the means by recursion."""
    taus = [h / 1e6 for h in SCALES.horizons]
    by = "(PARTITION BY run_id, channel ORDER BY header)"
    lag = lambda c, h: f"coalesce(last_value({c}) OVER (PARTITION BY run_id, channel ORDER BY header RANGE BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING), first_value({c}) OVER {by})"
    slope = lambda t, v: f"CASE WHEN (header - {t}) / 1e6 > 1e-6 THEN greatest(-4, least(4, (value - {v}) / ((header - {t}) / 1e6))) ELSE 0 END"
    lags = ", ".join(f"{lag('value', h)} AS lag_{k}, {lag('header', h)} AS at_{k}" for k, h in enumerate(SCALES.horizons, 1))
    slopes = ", ".join(f"{slope(f'at_{k}', f'lag_{k}')} AS slope_{k}" for k in (1, 2, 3))
    wheel = []
    for name, w in (("front", "f"), ("rear", "r")):
        age = f"least(coalesce((q.header - {w}.met) / 1e6, 864000), 864000)"
        wheel += [f"coalesce({w}.value, 0) AS {name}", f"{age} AS {name}_age", f"coalesce({w}.slope, 0) AS {name}_slope"]
        wheel += [f"coalesce({w}.slope_{k}, 0) AS {name}_slope_{k}" for k in (1, 2, 3)] + [f"coalesce({w}.lag_{k}, 0) AS {name}_lag_{k}" for k in (2, 3)]
        wheel.append(f"greatest(0, coalesce({w}.value, 0) + least({age}, 21600) * coalesce({w}.slope_1, 0)) AS {name}_ahead")
    out = {n: n for n in features.NAMES} | {"mean": "(front + rear) / 2", "difference": "front - rear", "abs_difference": "abs(front - rear)", "mean_ahead": "(front_ahead + rear_ahead) / 2"}
    columns = ", ".join(f"round({c}, {9 if 'slope' in n else 6})::DOUBLE + 0 AS {n}" for n, c in out.items())
    means = ", ".join(f"e.m{k} + (1 - exp(-((q.header - e.header) / 1e6) / {t})) * (q.value - e.m{k}) AS m{k}" for k, t in enumerate(taus, 1))
    return f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY header) AS n FROM kept WHERE channel = 'purchase'),
e AS (SELECT run_id, id, n, header, value AS m1, value AS m2, value AS m3 FROM q WHERE n = 1 UNION ALL SELECT q.run_id, q.id, q.n, q.header, {means} FROM e JOIN q ON q.run_id = e.run_id AND q.n = e.n + 1),
seen AS (SELECT q.run_id, q.id, w.channel, max(w.header) AS met FROM q JOIN kept w ON w.run_id = q.run_id AND w.channel IN ('click', 'view') AND w.arrival <= q.arrival AND w.header <= q.header GROUP BY ALL),
lagged AS (SELECT run_id, channel, header, value, lag(value) OVER {by} AS v0, lag(header) OVER {by} AS t0, {lags} FROM kept WHERE channel IN ('click', 'view')),
wheel AS (SELECT run_id, channel, header AS met, value, lag_2, lag_3, {slope('t0', 'v0')} AS slope, {slopes} FROM lagged),
known AS (SELECT seen.id, wheel.* FROM seen JOIN wheel USING (run_id, channel, met)),
found AS (SELECT q.run_id, q.id, q.header, q.arrival, q.value AS command, m1 AS command_ema_1, m2 AS command_ema_2, m3 AS command_ema_3, {', '.join(wheel)}
  FROM q JOIN e ON e.run_id = q.run_id AND e.id = q.id LEFT JOIN known f ON f.run_id = q.run_id AND f.id = q.id AND f.channel = 'click' LEFT JOIN known r ON r.run_id = q.run_id AND r.id = q.id AND r.channel = 'view')
SELECT run_id, id, header, arrival, {columns} FROM found"""


@query(_full_feature_sql())
def feature_row_26(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(spark, d).select("run_id", "id", "header", "arrival", *((F.round(n, 9 if "slope" in n else 6) + 0).alias(n) for n in features.NAMES))


def _observed(variant: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = feature_table(spark, d)
        aged = f.withColumns({c: F.col(c) / 86400 * 0.35 for c in ("front_age", "rear_age")})
        return observer.observe(aged, "run_id", "header", unit=86_400_000_000, rules=observer.Rules(variant))

    run.__name__ = f"observer_{variant}"
    query()(run)


for _v in ("gated", "simple", "linear"):
    _observed(_v)


@query(
    BASE
    + """SELECT id, CASE WHEN k IS NULL OR k > 50 THEN 0 ELSE k END AS command, k BETWEEN 10 AND 90 AS plausible,
  (CASE WHEN k > 50 THEN 64 ELSE 0 END) | (CASE WHEN value > 50 THEN 1 ELSE 0 END) | (CASE WHEN channel = 'error' THEN 8 ELSE 0 END) AS flags FROM base"""
)
def stale_command_and_mask(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    age = F.col("k") / 100
    flags = signals.mask({"stale_command": age > 0.5, "front_distrust": F.col("value") > 50, "not_initialized": F.col("channel") == "error"})
    return e.select("id", signals.command_or_zero(F.col("k"), age).alias("command"), F.col("k").between(10, 90).alias("plausible"), flags.alias("flags"))


@query(BASE + "SELECT id, channel IN ('click', 'view') AND value >= 0 AND value <= 144 AND header > 0 AND header <= arrival + 50000 AS wheel_ok, k BETWEEN -15 AND 15 AND header <= arrival + 50000 AS command_ok, value >= 0 AND abs(value) <= 90 AND abs(k) <= 180 AND header <= arrival + 50000 AS fix_ok FROM base")
def validity(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    no = F.when(F.col("channel") == "click", 0).when(F.col("channel") == "view", 1).otherwise(2)
    h, a = F.col("header"), F.col("arrival")
    return e.select(
        "id",
        signals.wheel_valid(no, F.col("value"), h, a, 1_000_000).alias("wheel_ok"),
        signals.command_valid(F.col("k"), h, a, 1_000_000).alias("command_ok"),
        signals.fix_valid(F.col("value"), F.col("k").cast("double"), F.lit(0.0), F.floor("value").cast("int"), h, a, 1_000_000).alias("fix_ok"),
    )


@query(
    """WITH f AS (SELECT event_id AS id, value AS a, 100 - value AS b, json_extract(props, '$.k')::INT / 100 AS x, (99 - json_extract(props, '$.k')::INT) / 100 AS y FROM events)
SELECT id, round(greatest(0, CASE WHEN x < 0.35 AND y < 0.35 THEN (a + b) / 2 WHEN x < 0.35 THEN a WHEN y < 0.35 THEN b WHEN x <= y THEN a ELSE b END), 6) AS speed FROM f"""
)
def fresh_baseline(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return events(spark, d).select("id", r6(signals.fresh_baseline(F.col("value"), 100 - F.col("value"), k / 100, (99 - k) / 100)).alias("speed"))


@query(
    BASE
    + """, s AS (SELECT id, 1 + 0.003 * value + k / 100 + CASE WHEN channel = 'error' THEN 10 ELSE 0 END + CASE WHEN value > 50 THEN 3 ELSE 0 END AS b, channel FROM base)
SELECT id, round(CASE WHEN channel = 'signup' THEN greatest(CASE WHEN channel = 'view' THEN greatest(b, 10) ELSE b END, 25) WHEN channel = 'view' THEN greatest(b, 10) ELSE b END, 9) AS sigma FROM s"""
)
def covariance_heuristic(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("channel")
    flags = signals.mask({"not_initialized": c == "error", "rear_distrust": F.col("value") > 50, "off_map": c == "view", "pair_conflict": c == "signup"})
    return events(spark, d).select("id", F.round(signals.position_sigma(F.col("value"), F.col("k") / 100, flags), 9).alias("sigma"))


@query(
    BASE
    + """, b AS (SELECT id, greatest(c, 0) / 15 AS p, least(c, 0) / 15 AS n, value AS v FROM (SELECT id, k % 31 - 15 AS c, value FROM base))
SELECT id, round(p, 9) AS b0, round(n, 9) AS b1, round(p * p, 9) AS b2, round(n * n, 9) AS b3, round(p * v / 15, 9) AS b4, round(n * v / 15, 9) AS b5, round(tanh(v / 0.3), 9) AS b6, round(v / 15, 9) AS b7, round(v / 15 * v / 15, 9) AS b8 FROM b"""
)
def drive_basis(spark: SparkSession, d: str) -> DataFrame:
    terms = signals.drive_basis(F.col("k") % 31 - 15, F.col("value"))
    return events(spark, d).select("id", *(F.round(t, 9).alias(k) for k, t in terms.items()))


@query(
    f"""SELECT run_id, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival, id) AS place FROM
(SELECT *, (header - min(header) OVER (PARTITION BY run_id)) / 1e6 AS elapsed FROM ({_full_feature_sql()})) f
WHERE front_age / 864000 < 0.3 AND rear_age / 864000 < 0.3 AND abs(difference) / 100 < 0.15 AND abs(front_slope_2 - rear_slope_2) * 1000 < 0.25 AND mean > 0.3 AND abs(front_slope_2) * 1000 < 1.8 AND elapsed > 5) WHERE (place - 1) % 5 = 0"""
)
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth of the rows from which a drive model may learn; ages and slopes in the scale of days."""
    f = feature_row_26(spark, d).withColumn("elapsed", (F.col("header") - F.min("header").over(Window.partitionBy("run_id"))) / 1e6)
    slope, other = F.col("front_slope_2") * 1000, F.col("rear_slope_2") * 1000
    good = signals.training_row(F.col("front_age") / 864000, F.col("rear_age") / 864000, F.col("difference") / 100, slope - other, F.col("mean"), slope, F.col("elapsed"))
    return ordering.every_nth(f.where(good), ["run_id"], 5, ("arrival", "id")).select("run_id", "id")


@query("SELECT event_id AS id, round(value / 3.6, 9) AS speed, 11 + value / 40 > 11.9 AND 11 + value / 40 < 12.9 AND json_extract(props, '$.k')::INT <= 50 AS pair_ok FROM events")
def units_and_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Raw readings in metres a second, and which antenna pairs are as far apart as they are mounted."""
    pair = signals.baseline_good(11 + F.col("value") / 40, F.col("k") * 1000, 1_000_000)
    return events(spark, d).select("id", F.round(signals.metres_per_second(F.col("value")), 9).alias("speed"), pair.alias("pair_ok"))


@query(
    BASE
    + """, p AS (SELECT run_id, value - 50 AS error, (arrival - min(arrival) OVER (PARTITION BY run_id)) / 86400000000 AS elapsed, k <= 50 AS ready FROM base),
q AS (SELECT 'every' AS phase, * FROM p UNION ALL SELECT 'startup', * FROM p WHERE elapsed < 3 UNION ALL SELECT 'after_startup', * FROM p WHERE elapsed >= 3 UNION ALL SELECT 'initialized', * FROM p WHERE ready
  UNION ALL SELECT 'initialized_after_startup', * FROM p WHERE ready AND elapsed >= 3)
SELECT phase, count(*)::BIGINT AS n, round(sqrt(avg(error * error)), 6) AS rmse FROM q GROUP BY 1"""
)
def phase_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors in each phase of a run, all phases in one pass."""
    e = events(spark, d)
    elapsed = (F.col("arrival") - F.min("arrival").over(Window.partitionBy("run_id"))) / DAY
    flags = signals.mask({"not_initialized": F.col("k") > 50})
    inside = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in signals.phases(F.col("elapsed"), F.col("flags")).items())))
    phased = e.withColumn("elapsed", elapsed).withColumn("flags", flags).select(F.explode(inside).alias("phase"), (F.col("value") - 50).alias("error"))
    return aggregates.error_metric(phased, ["phase"]).select("phase", "n", F.round("rmse", 6).alias("rmse"))


@query(
    BASE
    + f""", cuts AS (SELECT run_id, (min(arrival) + max(arrival)) // 2 AS cut FROM base GROUP BY run_id)
SELECT run_id, count(*)::BIGINT AS held, 0::BIGINT AS violations FROM {_PURCHASES} p JOIN cuts USING (run_id) WHERE p.arrival <= cut GROUP BY run_id"""
)
def causal_prefix(spark: SparkSession, d: str) -> DataFrame:
    """What a command knows does not change with what comes after half of a run."""
    every = events(spark, d)
    cuts = every.groupBy("run_id").agg(F.expr("(min(arrival) + max(arrival)) div 2").alias("cut"))

    def known(rows: DataFrame) -> DataFrame:
        wheel = ordering.record_high(rows.where("channel = 'click'"), KEY)
        lagged = wheel.withColumn("value", F.struct("value", windows.slope_horizon(KEY, "value", "header", DAY, 4.0).alias("slope")))
        return joins.asof_dual_clock(rows.where("channel = 'purchase'"), lagged, ["run_id"]).select("run_id", "id", "arrival", "r_header", "r_value")

    early, whole = known(ordering.prefix(every, cuts, "run_id", "arrival")), ordering.prefix(known(every), cuts, "run_id", "arrival")
    what = F.struct("r_header", "r_value")
    both = early.select("run_id", "id", what.alias("a"), F.lit(True).alias("_e")).join(whole.select("run_id", "id", what.alias("b"), F.lit(True).alias("_w")), ["run_id", "id"], "full")
    same = F.col("_e").eqNullSafe(F.col("_w")) & F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy("run_id").agg(F.count_if(same).alias("held"), F.count_if(~same).alias("violations"))
