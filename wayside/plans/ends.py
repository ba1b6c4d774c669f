"""Lines lengthened at their ends, over the events: a user's events are the points of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extensions
from .registry import BASE, events, query

#: Each run's line goes from the way travelled of its first point and so much, to that of its last point less as much.
INSIDE = 20.0
COLUMNS = ["x", "y"]


def points(spark: SparkSession, d: str) -> DataFrame:
    """run_id, way (about two further a point), x, y, begin and end."""
    every = events(spark, d)
    w = Window.partitionBy("run_id")
    n = F.row_number().over(w.orderBy("header", "id"))
    rows = every.select("run_id", (2 * n + F.pmod("id", F.lit(7)) / 8).alias("way"), F.col("value").alias("x"), (2 * n + F.col("k") / 4).alias("y"))
    return rows.withColumns({"begin": F.min("way").over(w) + INSIDE, "end": F.max("way").over(w) - INSIDE}).where("begin < end")


_POINTS_SQL = (
    BASE
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY header, id) AS n FROM base),
p0 AS (SELECT run_id, 2 * n + (id % 7) / 8.0::DOUBLE AS way, value AS x, 2 * n + k / 4.0::DOUBLE AS y FROM n),
p AS (SELECT * FROM (SELECT *, min(way) OVER (PARTITION BY run_id) + 20 AS start, max(way) OVER (PARTITION BY run_id) - 20 AS stop, min(way) OVER (PARTITION BY run_id) AS lo, max(way) OVER (PARTITION BY run_id) AS hi FROM p0) WHERE start < stop)
"""
)


@query(
    _POINTS_SQL
    + """, e AS (SELECT run_id, any_value(lo) AS lo, any_value(hi) AS hi FROM p GROUP BY run_id), g AS (SELECT run_id, i, lo + i * 1.5 AS way FROM e, range(ceil((hi - lo) / 1.5 - 1e-9)::BIGINT) u(i)),
b AS (SELECT g.*, p.way AS at0, p.x AS x0, p.y AS y0 FROM g ASOF JOIN p ON g.run_id = p.run_id AND g.way >= p.way),
f AS (SELECT b.*, p.way AS at1, p.x AS x1, p.y AS y1 FROM b ASOF JOIN p ON b.run_id = p.run_id AND b.way <= p.way)
SELECT run_id, count(*)::BIGINT AS n, round(sum(CASE WHEN at1 > at0 THEN x0 + (x1 - x0) * (way - at0) / (at1 - at0) ELSE x0 END), 4) AS total_x, round(sum(i * CASE WHEN at1 > at0 THEN y0 + (y1 - y0) * (way - at0) / (at1 - at0) ELSE y0 END), 2) AS total_y FROM f GROUP BY run_id"""
)
def even_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every run's points at even steps, summed."""
    rows = extensions.even_steps(points(spark, d), "run_id", "way", COLUMNS, 1.5)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total_x"), F.round(F.sum(F.col("i") * F.col("y")), 2).alias("total_y"))


@query(
    _POINTS_SQL
    + """, e AS (SELECT run_id, 'before' AS side, greatest(any_value(lo), 0) AS a, any_value(start) AS z, 0.0::DOUBLE AS tx, any_value(start) AS ty FROM p WHERE way < start + 10 GROUP BY run_id HAVING count(*) >= 5
  UNION ALL SELECT run_id, 'after', any_value(stop) + 1, any_value(hi), 1.0, any_value(stop) FROM p WHERE way > stop - 10 GROUP BY run_id HAVING count(*) >= 5),
g AS (SELECT run_id, side, tx, ty, i, ceil(z - a - 1e-9)::BIGINT AS n, a + i AS way FROM e, range(ceil(z - a - 1e-9)::BIGINT) u(i)),
b AS (SELECT g.*, p.way AS at0, p.x AS x0, p.y AS y0 FROM g ASOF JOIN p ON g.run_id = p.run_id AND g.way >= p.way),
f AS (SELECT b.*, p.way AS at1, p.x AS x1, p.y AS y1 FROM b ASOF JOIN p ON b.run_id = p.run_id AND b.way <= p.way),
v AS (SELECT run_id, side, tx, ty, i, n, way, CASE WHEN at1 > at0 THEN x0 + (x1 - x0) * (way - at0) / (at1 - at0) ELSE x0 END AS x, CASE WHEN at1 > at0 THEN y0 + (y1 - y0) * (way - at0) / (at1 - at0) ELSE y0 END AS y FROM f),
m AS (SELECT c.run_id, c.side, c.i, any_value(c.n) AS n, any_value(c.way) AS way, any_value(c.tx) AS tx, any_value(c.ty) AS ty, avg(o.x) AS x, avg(o.y) AS y
  FROM v c, (SELECT unnest([-2, -1, 0, 1, 2]) AS j) s JOIN v o ON o.run_id = c.run_id AND o.side = c.side AND o.i = greatest(0, least(c.n - 1, c.i + j)) WHERE c.n >= 2 GROUP BY c.run_id, c.side, c.i),
k AS (SELECT *, CASE WHEN side = 'before' THEN n - 1 - i ELSE i END AS k, CASE WHEN side = 'before' THEN last(x) OVER q ELSE first(x) OVER q END AS jx, CASE WHEN side = 'before' THEN last(y) OVER q ELSE first(y) OVER q END AS jy FROM m
  WINDOW q AS (PARTITION BY run_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT run_id, side, i, round(way, 6) AS way, round(x + (tx - jx) * greatest(0, 1 - k / (least(25, n) - 1)::DOUBLE), 6) AS x, round(y + (ty - jy) * greatest(0, 1 - k / (least(25, n) - 1)::DOUBLE), 6) AS y FROM k WHERE k > 0"""
)
def lengthened_ends(spark: SparkSession, d: str) -> DataFrame:
    """What each run adds before and after its line."""
    rows = points(spark, d)
    places = rows.groupBy("run_id").agg(F.first("begin").alias("first_y"), F.first("end").alias("last_y"))
    made = extensions.lengthened(rows, "run_id", "way", COLUMNS, F.col("begin"), F.col("end"), places, {"x": F.lit(0.0), "y": F.col("first_y")}, {"x": F.lit(1.0), "y": F.col("last_y")})
    return made.select("run_id", "side", "i", *(F.round(c, 6).alias(c) for c in ("way", "x", "y")))
