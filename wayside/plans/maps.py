"""Queries of geometry and map matching; the route is a ring through a vertex for each nation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import route as routes
from ..operators import fusion, matching, models, windows
from ..schema import Settings
from .registry import BASE, DAY, events, query, scratch, table

S = Settings()
ORIGIN = (S.origin_lat, S.origin_lon, S.origin_alt)


def ring(spark: SparkSession, d: str) -> DataFrame:
    """Vertices on a circle of 400 m with some relief, closed by repeating the first."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    every = n.unionByName(n.where("k = 0").select(F.lit(25).alias("k")))
    a = F.col("k") * 2 * F.pi() / 25
    points = every.select(F.lit("ring").alias("route"), "k", (400 * F.cos(a)).alias("x"), (400 * F.sin(a)).alias("y"), (3 * F.sin(2 * a)).alias("z"))
    return geo.arclength(points, ["route"], "k")


_RING = """WITH n AS (SELECT n_nationkey::INT AS k FROM nation UNION ALL SELECT 25), corner AS (SELECT k, 400 * cos(k * 2 * pi() / 25) AS x, 400 * sin(k * 2 * pi() / 25) AS y, 3 * sin(2 * (k * 2 * pi() / 25)) AS z FROM n),
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS d FROM corner WINDOW w AS (ORDER BY k)), r AS (SELECT k, x, y, z, sum(d) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM l),
seg AS (SELECT k, s AS s0, lead(s) OVER w AS s1, x AS x0, y AS y0, z AS z0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM r WINDOW w AS (ORDER BY s))
"""
#: Points near the ring, from the events.
_POINT = "SELECT event_id AS id, (380 + json_extract(props, '$.k')::INT / 3) * cos(event_id * 0.01) AS px, (380 + json_extract(props, '$.k')::INT / 3) * sin(event_id * 0.01) AS py, value / 50 AS pz FROM events"


def points(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    r, a = 380 + F.col("k") / 3, F.col("id") * 0.01
    return e.select("id", "run_id", (r * F.cos(a)).alias("px"), (r * F.sin(a)).alias("py"), (F.col("value") / 50).alias("pz"), "arrival", "header")


def _vector(v: tuple, names: str, digits: int = 5) -> list:
    return [F.round(c, digits).alias(n) for c, n in zip(v, names, strict=True)]


_LLA = "SELECT event_id AS id, 55.805 + (json_extract(props, '$.k')::INT - 50) * 0.0001 AS lat, 37.425 + (value - 50) * 0.0001 AS lon, 170 + value / 10 AS alt FROM events"
_ECEF = f"WITH l AS ({_LLA}), g AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, 6378137.0 / sqrt(1 - 6.6943799901413165e-3 * sin(radians(lat)) * sin(radians(lat))) AS n FROM l), e AS (SELECT id, (n + alt) * cos(la) * cos(lo) AS x, (n + alt) * cos(la) * sin(lo) AS y, (n * (1 - 6.6943799901413165e-3) + alt) * sin(la) AS z FROM g) "


def lla_points(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("id", (55.805 + (F.col("k") - 50) * 0.0001).alias("lat"), (37.425 + (F.col("value") - 50) * 0.0001).alias("lon"), (170 + F.col("value") / 10).alias("alt"))


@query(_ECEF + "SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM e")
def lla_to_ecef(spark: SparkSession, d: str) -> DataFrame:
    return lla_points(spark, d).select("id", *_vector(geo.ecef(F.col("lat"), F.col("lon"), F.col("alt")), "xyz", 4))


@query(
    _ECEF
    + """, o AS (SELECT radians(55.805) AS la, radians(37.425) AS lo, 6378137.0 / sqrt(1 - 6.6943799901413165e-3 * sin(radians(55.805)) * sin(radians(55.805))) AS n),
d AS (SELECT id, x - (n + 170) * cos(la) * cos(lo) AS x, y - (n + 170) * cos(la) * sin(lo) AS y, z - (n * (1 - 6.6943799901413165e-3) + 170) * sin(la) AS z, la, lo FROM e, o)
SELECT id, round(-sin(lo) * x + cos(lo) * y, 4) AS e, round(-sin(la) * cos(lo) * x - sin(la) * sin(lo) * y + cos(la) * z, 4) AS n, round(cos(la) * cos(lo) * x + cos(la) * sin(lo) * y + sin(la) * z, 4) AS u FROM d"""
)
def lla_to_enu(spark: SparkSession, d: str) -> DataFrame:
    return lla_points(spark, d).select("id", *_vector(geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), ORIGIN), "enu", 4))


@query(f"WITH l AS ({_LLA}) SELECT id, round(lat::DOUBLE, 9) AS lat, round(lon::DOUBLE, 9) AS lon, round(alt::DOUBLE, 4) AS alt FROM l")
def enu_to_lla_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = lla_points(spark, d)
    local = e.select("id", *(c.alias(n) for c, n in zip(geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), ORIGIN), "xyz", strict=True)))
    lat, lon, alt = geo.lla(F.col("x"), F.col("y"), F.col("z"), ORIGIN)
    return local.select("id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.round(alt, 4).alias("alt"))


@query(f"WITH p AS ({_POINT}) SELECT id, round(cos(0.3) * px - sin(0.3) * py + 12.5, 5) AS x, round(sin(0.3) * px + cos(0.3) * py - 3, 5) AS y, round(pz + 1, 5) AS z FROM p")
def rigid_transform(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", *_vector(geo.rigid(geo.vector("px", "py", "pz"), 0.3, (12.5, -3.0, 1.0)), "xyz"))


_FRAME = f"WITH p AS ({_POINT}), f AS (SELECT *, px / n AS fx, py / n AS fy, pz / n AS fz, sqrt(px * px + py * py) / n AS h FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM p)) "


@query(_FRAME + "SELECT id, round(fx, 9) AS fx, round(fy, 9) AS fy, round(fz, 9) AS fz, round(-fy / h, 9) AS lx, round(fx / h, 9) AS ly, round(-fz * fx / h, 9) AS ux, round(-fz * fy / h, 9) AS uy, round(h, 9) AS uz FROM f")
def body_frame(spark: SparkSession, d: str) -> DataFrame:
    f, left, up = geo.body_axes(geo.vector("px", "py", "pz"))
    return points(spark, d).select("id", *_vector(f, ["fx", "fy", "fz"], 9), *_vector(left[:2], ["lx", "ly"], 9), *_vector(up, ["ux", "uy", "uz"], 9))


@query(_FRAME + "SELECT id, round(px + 2.563 * fx - 3 * fz * fx / h, 5) AS x, round(py + 2.563 * fy - 3 * fz * fy / h, 5) AS y, round(pz + 2.563 * fz + 3 * h, 5) AS z FROM f")
def antenna_point(spark: SparkSession, d: str) -> DataFrame:
    v = geo.vector("px", "py", "pz")
    return points(spark, d).select("id", *_vector(geo.antenna(v, v, S.antenna_front, S.antenna_height), "xyz"))


@query(f"WITH p AS ({_POINT}) SELECT id, round(px, 5) AS x, round(py, 5) AS y, round(pz, 5) AS z FROM p")
def body_from_antennas(spark: SparkSession, d: str) -> DataFrame:
    """Both antennas of a body give its position back."""
    v = geo.vector("px", "py", "pz")
    rear, front = (geo.antenna(v, v, x, S.antenna_height) for x in (S.antenna_rear, S.antenna_front))
    return points(spark, d).select("id", *_vector(geo.from_antennas(rear, front, S.antenna_rear, S.antenna_height), "xyz"))


@query(f"WITH p AS ({_POINT}), a AS (SELECT id, atan2(py, px) / 2 AS y, -atan2(pz, sqrt(px * px + py * py)) / 2 AS p FROM p) SELECT id, round(-sin(y) * sin(p), 9) AS qx, round(cos(y) * sin(p), 9) AS qy, round(sin(y) * cos(p), 9) AS qz, round(cos(y) * cos(p), 9) AS qw FROM a")
def pose_quaternion(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", *(F.round(c, 9).alias(n) for n, c in geo.quaternion(geo.vector("px", "py", "pz")).items()))


@query(_RING + "SELECT k, round(s, 6) AS s, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM r")
def arclength(spark: SparkSession, d: str) -> DataFrame:
    return ring(spark, d).select("k", F.round("s", 6).alias("s"), (F.round("x", 6) + 0).alias("x"), (F.round("y", 6) + 0).alias("y"))


@query(
    _RING
    + """, q AS (SELECT event_id AS id, value * 37.3 - (SELECT max(s) FROM r) * floor(value * 37.3 / (SELECT max(s) FROM r)) AS way FROM events)
SELECT id, round(x0 + (x1 - x0) * (way - s0) / (s1 - s0), 4) AS x, round(y0 + (y1 - y0) * (way - s0) / (s1 - s0), 4) AS y, round(z0 + (z1 - z0) * (way - s0) / (s1 - s0), 4) AS z FROM q ASOF JOIN (SELECT * FROM seg WHERE s1 IS NOT NULL) g ON q.way >= g.s0"""
)
def polyline_at(spark: SparkSession, d: str) -> DataFrame:
    way = routes.Route.of(ring(spark, d), closed=True)
    return events(spark, d).withColumn("p", routes.point_at(way, F.col("value") * 37.3)).select("id", *(F.round(f"p.{c}", 4).alias(c) for c in "xyz"))


@query(
    f"""{_RING}, p AS ({_POINT}), c AS (SELECT id, greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS w, * FROM p, seg WHERE s1 IS NOT NULL),
d AS (SELECT id, sqrt((x0 + w * (x1 - x0) - px) ** 2 + (y0 + w * (y1 - y0) - py) ** 2) AS d FROM c)
SELECT id, round(min(d), 5) AS distance FROM d GROUP BY id"""
)
def project_flat(spark: SparkSession, d: str) -> DataFrame:
    way = routes.Route.of(ring(spark, d), closed=True)
    m = routes.project(way, F.col("px"), F.col("py"), F.col("pz"), flat=True)
    return points(spark, d).withColumn("m", m).select("id", F.round("m.distance", 5).alias("distance"))


@query(
    f"""{_RING}, p AS ({_POINT}), c AS (SELECT id, px, py, pz, s0, s1, x0, y0, z0, x1, y1, z1, greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0) + (pz - z0) * (z1 - z0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2))) AS w FROM p, seg WHERE s1 IS NOT NULL)
SELECT id, round(min(sqrt((x0 + w * (x1 - x0) - px) ** 2 + (y0 + w * (y1 - y0) - py) ** 2 + (z0 + w * (z1 - z0) - pz) ** 2)), 5) AS distance FROM c GROUP BY id"""
)
def project_top8(spark: SparkSession, d: str) -> DataFrame:
    way = routes.Route.of(ring(spark, d), closed=True)
    return points(spark, d).withColumn("m", routes.project(way, F.col("px"), F.col("py"), F.col("pz"))).select("id", F.round("m.distance", 5).alias("distance"))


#: Segments of the ring are longer than the chord, so the rear pivot is on the front's segment or on the one before.
_POSE = f"""{_RING}, g AS (SELECT *, coalesce(lag(k) OVER (ORDER BY k), (SELECT max(k) FROM seg WHERE s1 IS NOT NULL)) AS k0 FROM seg WHERE s1 IS NOT NULL),
q AS (SELECT event_id AS id, value * 37.3 - (SELECT max(s) FROM r) * floor(value * 37.3 / (SELECT max(s) FROM r)) AS way FROM events),
f AS (SELECT q.id, g.*, way - s0 AS into_it, (x1 - x0) / (s1 - s0) AS wx, (y1 - y0) / (s1 - s0) AS wy, (z1 - z0) / (s1 - s0) AS wz FROM q ASOF JOIN g ON q.way >= g.s0),
h AS (SELECT f.*, x0 + into_it * wx AS px, y0 + into_it * wy AS py, z0 + into_it * wz AS pz FROM f),
b AS (SELECT h.id, px, py, pz, into_it, h.wx, h.wy, h.wz, p.x0 AS ax, p.y0 AS ay, p.z0 AS az, (p.x1 - p.x0) / (p.s1 - p.s0) AS ux, (p.y1 - p.y0) / (p.s1 - p.s0) AS uy, (p.z1 - p.z0) / (p.s1 - p.s0) AS uz FROM h JOIN g p ON p.k = h.k0),
c AS (SELECT *, (px - ax) * ux + (py - ay) * uy + (pz - az) * uz AS m, (px - ax) ** 2 + (py - ay) ** 2 + (pz - az) ** 2 AS sq FROM b),
d AS (SELECT *, m - sqrt(greatest(0, m * m - sq + 7.55 ** 2)) AS u FROM c),
e AS (SELECT id, px, py, pz, CASE WHEN into_it >= 7.55 THEN wx ELSE (px - ax - u * ux) / 7.55 END AS fx, CASE WHEN into_it >= 7.55 THEN wy ELSE (py - ay - u * uy) / 7.55 END AS fy, CASE WHEN into_it >= 7.55 THEN wz ELSE (pz - az - u * uz) / 7.55 END AS fz FROM d)
"""


@query(_POSE + "SELECT id, round(px, 4) AS x, round(py, 4) AS y, round(pz, 4) AS z, round(fx, 6) AS fx, round(fy, 6) AS fy, round(fz, 6) AS fz FROM e")
def pose_bisect(spark: SparkSession, d: str) -> DataFrame:
    """Front pivot and direction; the name is the survey's, the root is in closed form."""
    way = routes.Route.of(ring(spark, d), closed=True)
    placed = events(spark, d).withColumn("p", routes.pose_at(way, F.col("value") * 37.3))
    return placed.select("id", *(F.round(f"p.{c}", 6 if c[0] == "f" else 4).alias(c) for c in ("x", "y", "z", "fx", "fy", "fz")))


def _pose_sql(shift: float) -> str:
    """Front pivot and direction ``shift`` metres further on, by id."""
    moved = _POSE.replace("value * 37.3", f"(value * 37.3 + {shift})")
    return moved[moved.index("q AS (") :].rstrip()


def _antenna(x: float) -> str:
    """The place of an antenna beside a pose: ``x`` ahead, at the antennas' height."""
    up = ("-fz * fx / h", "-fz * fy / h", "h")
    return ", ".join(f"p{c} + {x} * f{c} + {S.antenna_height} * ({u}) AS a{c}" for c, u in zip("xyz", up, strict=True))


def _ends_sql(columns: str) -> str:
    """Two CTEs, lo and hi: ``columns`` of the poses 5 cm before and behind each place."""
    parts = [_POSE[: _POSE.index("q AS (")].rstrip()]
    for name, shift in (("lo", -0.05), ("hi", 0.05), ("mid", 0.0)):
        own = _pose_sql(shift)
        for cte in "qfhbcde":
            own = own.replace(f"\n{cte} AS (", f"\n{cte}{name} AS (").replace(f"FROM {cte})", f"FROM {cte}{name})").replace(f"FROM {cte} ", f"FROM {cte}{name} ")
        own = own.replace("q AS (", f"q{name} AS (", 1).replace("SELECT q.id", f"SELECT q{name}.id").replace("ON q.way", f"ON q{name}.way").replace("SELECT f.*", f"SELECT f{name}.*").replace("SELECT h.id", f"SELECT h{name}.id").replace("wx, h.wy", f"wx, h{name}.wy").replace("h.wx", f"h{name}.wx").replace("h.wz", f"h{name}.wz").replace("p.k = h.k0", f"p.k = h{name}.k0")
        parts.append(f"{own},\n{name} AS (SELECT id, {columns} FROM (SELECT *, sqrt(fx * fx + fy * fy) AS h FROM e{name}))")
    return parts[0] + "\n" + ",\n".join(parts[1:])


@query(_ends_sql(_antenna(S.antenna_front)) + " SELECT lo.id, round(sqrt((hi.ax - lo.ax) ** 2 + (hi.ay - lo.ay) ** 2) / 0.1, 6) AS factor FROM lo JOIN hi USING (id)")
def speed_factor(spark: SparkSession, d: str) -> DataFrame:
    way = routes.Route.of(ring(spark, d), closed=True)
    return events(spark, d).select("id", F.round(routes.speed_factor_at(way, F.col("value") * 37.3, S.antenna_front, S.antenna_height), 6).alias("factor"))


@query(
    _ends_sql("px, py, pz, fx, fy, fz, h")
    + """, d AS (SELECT lo.id, (hi.px - lo.px) * 50 AS dx, (hi.py - lo.py) * 50 AS dy, (hi.pz - lo.pz) * 50 AS dz, atan2(lo.fx * hi.fy - lo.fy * hi.fx, lo.fx * hi.fx + lo.fy * hi.fy) * 50 AS wz, mid.* EXCLUDE id
  FROM lo JOIN hi USING (id) JOIN mid USING (id))
SELECT id, round(dx * fx + dy * fy + dz * fz, 5) + 0 AS vx, round((dy * fx - dx * fy) / h, 5) + 0 AS vy, round((-fz * (dx * fx + dy * fy) + dz * h * h) / h, 5) + 0 AS vz, round(wz, 6) + 0 AS wz FROM d"""
)
def body_twist(spark: SparkSession, d: str) -> DataFrame:
    way = routes.Route.of(ring(spark, d), closed=True)
    return events(spark, d).withColumn("t", routes.twist_at(way, F.col("value") * 37.3, F.lit(5.0))).select("id", *((F.round(f"t.{c}", 6 if c == "wz" else 5) + 0).alias(c) for c in ("vx", "vy", "vz", "wz")))


@query(f"{_RING}, t AS (SELECT max(s) AS turn FROM r) SELECT event_id AS id, true AS there, 0::DOUBLE AS distance FROM events, t")
def project_two_antennas(spark: SparkSession, d: str) -> DataFrame:
    """there: whether the place found is that from which the antennas were laid out, but for laps and a millimetre; distance: to a centimetre."""
    way = routes.Route.of(ring(spark, d), closed=True)
    placed = events(spark, d).withColumn("p", routes.pose_at(way, F.col("value") * 37.3))
    position, forward = geo.vector("p.x", "p.y", "p.z"), geo.vector("p.fx", "p.fy", "p.fz")
    rear, front = (geo.antenna(position, forward, x, S.antenna_height) for x in (S.antenna_rear, S.antenna_front))
    m = routes.project_antennas(way, rear, front, S.antenna_rear, S.antenna_front, S.antenna_height)
    laps = (F.col("m.s") - F.col("value") * 37.3) / way.end
    return placed.withColumn("m", m).select("id", (F.abs(laps - F.round(laps)) * way.end < 1e-3).alias("there"), (F.round("m.distance", 2) + 0).alias("distance"))


@query("WITH u AS (SELECT event_id AS id, least(greatest(value / 100, 0), 1) AS u FROM events), t AS (SELECT id, 2 * u - 1 AS t, 16 * u * u * (1 - u) * (1 - u) AS e FROM u) SELECT id, round(e, 9) AS l0, round(e * t, 9) AS l1, round(e * (3 * t * t - 1) / 2, 9) AS l2, round(e * (5 * t ** 3 - 3 * t) / 2, 9) AS l3 FROM t")
def legendre_basis(spark: SparkSession, d: str) -> DataFrame:
    terms = geo.legendre_envelope(F.col("value") / 100, 3)
    return events(spark, d).select("id", *(F.round(t, 9).alias(f"l{k}") for k, t in enumerate(terms)))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "signup", "error", "click")
    return e.select("run_id", F.when(F.col("channel") == "click", "a").otherwise("b").alias("route"), F.col("arrival").alias("stamp"), (F.col("value") * 3).alias("offset"), (F.col("k") * 5.0).alias("cost"), ((F.col("k") % 9 - 4) / 4).alias("base_error"), F.lit(None).cast("double").alias("closed_length"))


@query(
    """WITH p AS (SELECT user_id AS run_id, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS route, value * 3 AS o, json_extract(props, '$.k')::INT * 5.0 AS c, (json_extract(props, '$.k')::INT % 9 - 4) / 4 AS e FROM events WHERE event_type IN ('signup', 'error', 'click')),
g AS (SELECT run_id, route, median(o) FILTER (WHERE abs(e) <= 0.5) AS so, median(c) FILTER (WHERE abs(e) <= 0.5) AS sc, median(o) AS lo, median(c) AS lc, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT run_id, route, CASE WHEN sc < 400 THEN so ELSE lo END AS o, CASE WHEN sc < 400 THEN sc WHEN n >= 3 AND lc < 400 THEN lc END AS c, NOT coalesce(sc < 400, false) AS degraded FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY degraded, c, route) AS i FROM h WHERE c IS NOT NULL)
SELECT run_id, route, round(o, 4) AS "offset", round(sqrt(c), 4) AS init_rms, degraded FROM k WHERE i = 1"""
)
def initializer_median(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.initial_match(_pairs(spark, d), "run_id")
    return found.select("run_id", "route", F.round("offset", 4).alias("offset"), F.round("init_rms", 4).alias("init_rms"), "degraded")


@query()
def sparse_correction(spark: SparkSession, d: str) -> DataFrame:
    """Fixes near the ring, off by a few metres and some far away, correct each run's track."""
    way = routes.Route.of(ring(spark, d), closed=True)
    e = events(spark, d, "signup", "error")
    truth = F.col("value") * 37.3
    placed = e.withColumn("p", routes.pose_at(way, truth + 3))
    off = F.when(F.col("k") % 10 == 0, 500.0).otherwise((F.col("k") - 50) / 25)
    fixes = placed.select("run_id", "id", "arrival", (F.col("arrival") - F.col("k") * 15_000).alias("stamp"), truth.alias("distance"), (F.col("p.x") + off).alias("x"), F.col("p.y").alias("y"), F.lit(0.0).alias("ahead"))
    return fusion.corrections(fixes, "run_id", way)


@query()
def off_map_modes(spark: SparkSession, d: str) -> DataFrame:
    e = points(spark, d)
    way = routes.Route.of(ring(spark, d), closed=True)
    m = e.withColumn("m", routes.project(way, F.col("px"), F.col("py"), F.col("pz"), flat=True))
    pairs = m.select("run_id", "id", (F.col("arrival") / 86400).cast("long").alias("stamp"), (F.col("id") * 4.0).alias("distance"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("m.distance").alias("apart"), F.lit(1.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(1.0).alias("hx"), F.lit(0.0).alias("hy"), F.col("m.s").alias("place"), F.lit(way.end).alias("turn"), F.when(F.col("id") % 11 == 0, 0.9).otherwise(0.0).alias("base_error"))
    return fusion.departures(pairs, "run_id")


@query(
    """WITH e AS (SELECT event_id AS id, user_id AS run_id, (event_type = 'error')::INT AS side, epoch_us(ts) AS arrival, epoch_us(ts) - json_extract(props, '$.k')::BIGINT * 3600000000 AS stamp FROM events WHERE event_type IN ('signup', 'error')),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, side ORDER BY arrival, id) AS k FROM e),
c AS (SELECT a.run_id, a.id, b.id AS mate_id, abs(a.stamp - b.stamp) AS gap, b.k, max(b.k) OVER (PARTITION BY a.run_id, a.id) AS newest, a.arrival - b.stamp AS old, a.id AS own
  FROM n a JOIN n b ON a.run_id = b.run_id AND a.side <> b.side AND (b.arrival < a.arrival OR (b.arrival = a.arrival AND b.id < a.id))),
m AS (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY gap, k) AS place FROM c WHERE k > newest - 64 AND gap <= 86400000000 AND old BETWEEN 0 AND 864000000000)
SELECT e.run_id, e.id, mate_id FROM e LEFT JOIN m ON m.run_id = e.run_id AND m.id = e.id AND place = 1"""
)
def live_mates(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "signup", "error")
    fixes = e.select("run_id", "id", "arrival", F.col("header").alias("stamp"), (F.col("channel") == "error").cast("int").alias("side"))
    return fusion.live_mates(fixes, "run_id", 86400.0, 864000.0)


@query(
    f"""{_RING}, e AS (SELECT k, (x1 - x0) / (s1 - s0) AS ux, (y1 - y0) / (s1 - s0) AS uy FROM seg WHERE s1 IS NOT NULL),
t AS (SELECT r.*, a.ux + b.ux AS tx, a.uy + b.uy AS ty, least(1, greatest(0, (s - 500) / 1000)) AS u FROM r JOIN e a ON a.k = r.k % 25 JOIN e b ON b.k = (r.k + 24) % 25),
w AS (SELECT *, CASE WHEN s BETWEEN 500 AND 1500 THEN 16 * u * u * (1 - u) * (1 - u) * (2 - (2 * u - 1) + 0.5 * (3 * (2 * u - 1) ** 2 - 1) / 2) ELSE 0 END AS m, sqrt(tx * tx + ty * ty) AS l FROM t),
v AS (SELECT k, x - m * ty / l AS x, y + m * tx / l AS y, z FROM w),
d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2 + (z - lag(z) OVER o) ** 2), 0) AS step FROM v WINDOW o AS (ORDER BY k))
SELECT k, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(sum(step) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS s FROM d"""
)
def deformed_ring(spark: SparkSession, d: str) -> DataFrame:
    """A stretch of the ring moved aside by a curve that is flat at both its ends."""
    corners = ring(spark, d)
    way = routes.Route.of(corners, closed=True)
    return routes.deformed(corners, way, ["route"], "k", 500.0, 1500.0, [2.0, -1.0, 0.5]).select("k", *((F.round(c, 6) + 0).alias(c) for c in ("x", "y", "s")))


# A spiral of a vertex for each order, more than a task should hold, cut to sheets

_SPIRAL = """WITH v AS (SELECT o_orderkey // 5000 AS route, o_orderkey AS k, (50 + o_orderkey * 0.02) * cos(o_orderkey * 0.05) AS x, (50 + o_orderkey * 0.02) * sin(o_orderkey * 0.05) AS y, 0.0 AS z FROM orders),
seg AS (SELECT route, k, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY route ORDER BY k)),
s AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS l FROM seg WHERE x1 IS NOT NULL),
p AS (SELECT event_id AS id, (value - 50) * 6 AS px, (json_extract(props, '$.k')::INT - 50) * 6.1 AS py, cos(event_id * 0.01) AS hx, sin(event_id * 0.01) AS hy FROM events),
c AS (SELECT id, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (l * l) AS u, * EXCLUDE id FROM p, s),
d AS (SELECT id, (x0 + least(greatest(u, 0), 1) * (x1 - x0) - px) ** 2 + (y0 + least(greatest(u, 0), 1) * (y1 - y0) - py) ** 2 + 25 * (1 - ((x1 - x0) * hx + (y1 - y0) * hy) / l) ** 2 AS cost FROM c)
"""


@query(_SPIRAL + "SELECT id, round(min(cost), 4) AS best, round(list_sum(min(cost, 8)), 3) AS eight FROM d GROUP BY id")
def match_segments(spark: SparkSession, d: str) -> DataFrame:
    """The cost of each event's best match on a spiral with headings, and of its best eight together, through a grid of segments."""
    k = F.col("o_orderkey")
    vertices = table(spark, d, "orders").select(F.floor(k / 5000).alias("route"), k.alias("k"), ((50 + k * 0.02) * F.cos(k * 0.05)).alias("x"), ((50 + k * 0.02) * F.sin(k * 0.05)).alias("y"), F.lit(0.0).alias("z"))
    e = events(spark, d)
    asked = e.select("id", ((F.col("value") - 50) * 6).alias("px"), ((F.col("k") - 50) * 6.1).alias("py"), F.lit(0.0).alias("pz"), F.cos(F.col("id") * 0.01).alias("hx"), F.sin(F.col("id") * 0.01).alias("hy"), F.lit(0.0).alias("hz"))
    found = matching.match(asked, matching.segments_of(vertices), 16.0, scratch(spark, "match"))
    return found.groupBy("id").agg(F.round(F.min("cost"), 4).alias("best"), F.round(F.sum("cost"), 3).alias("eight"))


@query(
    BASE
    + """, c AS (SELECT run_id, id, header AS t, header / 3.6e9 AS d, row_number() OVER (PARTITION BY run_id ORDER BY header) AS n, (header / 3.6e9) * 0.7 + k * 0.5 AS x, (header / 3.6e9) * 0.7 - value * 0.3 AS y FROM kept WHERE channel = 'click'),
w AS (SELECT a.run_id, a.id, b.d, b.x, b.y FROM c a JOIN c b ON a.run_id = b.run_id AND b.n BETWEEN a.n - 7 AND a.n AND b.t >= a.t - 432000000000),
g AS (SELECT run_id, id, count(*) AS course_n, avg(d) AS md, avg(x) AS mx, avg(y) AS my, CASE WHEN var_pop(d) * count(*) > 1e-12 THEN covar_pop(x, d) / var_pop(d) END AS gx, CASE WHEN var_pop(d) * count(*) > 1e-12 THEN covar_pop(y, d) / var_pop(d) END AS gy, max(d) - min(d) AS way FROM w GROUP BY ALL),
m AS (SELECT run_id, id, max(course_n) AS course_n, max(gx) AS gx, max(gy) AS gy, max(way) AS way, sqrt(avg((x - mx - gx * (d - md)) ** 2 + (y - my - gy * (d - md)) ** 2)) AS rms, max(sqrt((x - mx - gx * (d - md)) ** 2 + (y - my - gy * (d - md)) ** 2)) AS worst FROM w JOIN g USING (run_id, id) GROUP BY ALL)
SELECT run_id, id, course_n::INT AS course_n, round(sqrt(gx * gx + gy * gy), 5) AS gain, round(rms, 4) AS rms, round(worst, 4) AS worst, coalesce(course_n >= 4 AND way >= 20 AND sqrt(gx * gx + gy * gy) BETWEEN 0.8 AND 1.2 AND worst <= 25 AND rms <= 16, false) AS sound FROM m"""
)
def course_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The course of each click's last eight within five days, in hours, with all its tests."""
    from .streams import kept

    hours = F.col("header") / 3.6e9
    seen = kept(spark, d).where("channel = 'click'").select("run_id", "id", "header", hours.alias("way"), (hours * 0.7 + F.col("k") * 0.5).alias("x"), (hours * 0.7 - F.col("value") * 0.3).alias("y"))
    found = windows.course(seen, ["run_id"], "way", "x", "y", "header", 8, 5 * DAY, 4, 20.0, worst=25.0, rms=16.0)
    return found.select("run_id", "id", "course_n", F.round("gain", 5).alias("gain"), F.round("rms", 4).alias("rms"), F.round("worst", 4).alias("worst"), "sound")


@query("SELECT 0.4::DOUBLE AS turn, 7.0::DOUBLE AS dx, -3.0::DOUBLE AS dy, count(*) FILTER (WHERE event_id % 10 > 2) AS inliers, 0::BIGINT AS strays FROM events")
def rigid_inliers(spark: SparkSession, d: str) -> DataFrame:
    """A turn and a shift recovered from places of which three in ten are wrong; inliers agree to a millimetre."""
    e = events(spark, d)
    wild = lambda n: (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(20001)) - 10000) / 50
    x, y, wrong = F.col("value"), F.col("k") + F.col("id") * 0.001, F.col("id") % 10 < 3
    pairs = e.select("id", x.alias("x"), y.alias("y"), wrong.alias("wrong"), F.when(wrong, wild(1)).otherwise(x * math.cos(0.4) - y * math.sin(0.4) + 7).alias("u"), F.when(wrong, wild(2)).otherwise(x * math.sin(0.4) + y * math.cos(0.4) - 3).alias("v"))
    turn, shift, _ = models.rigid_fit(pairs, ("x", "y"), ("u", "v"))
    miss = F.hypot(F.col("x") * math.cos(turn) - F.col("y") * math.sin(turn) + shift[0] - F.col("u"), F.col("x") * math.sin(turn) + F.col("y") * math.cos(turn) + shift[1] - F.col("v"))
    return pairs.agg(F.lit(round(turn, 6)).alias("turn"), F.lit(round(shift[0], 4)).alias("dx"), F.lit(round(shift[1], 4)).alias("dy"), F.count_if((miss < 1e-3) & ~F.col("wrong")).alias("inliers"), F.count_if((miss < 1e-3) & F.col("wrong")).alias("strays"))
