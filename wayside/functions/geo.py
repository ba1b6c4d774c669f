"""Geometry as column expressions: vectors are three columns, so everything stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
EARTH_RADIUS = 6378137.0
EARTH_E2 = 6.6943799901413165e-3

Vector = tuple[Column, Column, Column]


def vector(*parts: Column | str | float) -> Vector:
    return tuple(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(float(p)) for p in parts)


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, k: Column | float) -> Vector:
    return tuple(x * k for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = F.greatest(norm(a), F.lit(1e-12))
    return tuple(x / n for x in a)


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def ecef(lat: Column, lon: Column, alt: Column) -> Vector:
    """Earth-centred coordinates of degrees and metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = EARTH_RADIUS / F.sqrt(1 - EARTH_E2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - EARTH_E2) + alt) * F.sin(la)


def _origin(origin: Sequence[float]) -> tuple[float, ...]:
    la, lo, h = math.radians(origin[0]), math.radians(origin[1]), origin[2]
    n = EARTH_RADIUS / math.sqrt(1 - EARTH_E2 * math.sin(la) ** 2)
    return (n + h) * math.cos(la) * math.cos(lo), (n + h) * math.cos(la) * math.sin(lo), (n * (1 - EARTH_E2) + h) * math.sin(la)


def _rotation(origin: Sequence[float]) -> list[list[float]]:
    la, lo = math.radians(origin[0]), math.radians(origin[1])
    sa, ca, so, co = math.sin(la), math.cos(la), math.sin(lo), math.cos(lo)
    return [[-so, co, 0.0], [-sa * co, -sa * so, ca], [ca * co, ca * so, sa]]


def enu(lat: Column, lon: Column, alt: Column, origin: Sequence[float]) -> Vector:
    """East, north and up of an origin given in degrees and metres."""
    d = sub(ecef(lat, lon, alt), vector(*_origin(origin)))
    return tuple(row[0] * d[0] + row[1] * d[1] + row[2] * d[2] for row in _rotation(origin))


def lla(east: Column, north: Column, up: Column, origin: Sequence[float], rounds: int = 5) -> Vector:
    """Degrees and metres of a point in an origin's frame; each round gains some three digits of latitude."""
    base, r = _origin(origin), _rotation(origin)
    x, y, z = (base[k] + r[0][k] * east + r[1][k] * north + r[2][k] * up for k in range(3))
    p = F.sqrt(x * x + y * y)
    # The latitude's fixed point, unrolled over an array fold so that the expression does not double each round.
    start = F.struct(F.atan2(z, p * (1 - EARTH_E2)).alias("la"), F.lit(0.0).alias("h"))

    def step(s: Column, _: Column) -> Column:
        n = EARTH_RADIUS / F.sqrt(1 - EARTH_E2 * F.sin(s["la"]) * F.sin(s["la"]))
        h = p / F.cos(s["la"]) - n
        return F.struct(F.atan2(z, p * (1 - EARTH_E2 * n / (n + h))).alias("la"), h.alias("h"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.degrees(s["la"]), F.degrees(F.atan2(y, x)), s["h"]


def body_axes(direction: Vector) -> tuple[Vector, Vector, Vector]:
    """Forward, left and up of a body without roll that points in a direction."""
    f = unit(direction)
    left = unit((-f[1], f[0], F.lit(0.0)))
    return f, left, cross(f, left)


def antenna(position: Vector, direction: Vector, x: float, height: float) -> Vector:
    """A point of the body: ``x`` ahead of its position and ``height`` above."""
    f, _, up = body_axes(direction)
    return add(position, add(scale(f, x), scale(up, height)))


def from_antennas(rear: Vector, front: Vector, x: float, height: float) -> Vector:
    """The body's position from its two antennas, the rear one ``x`` ahead of it."""
    f, _, up = body_axes(sub(front, rear))
    return sub(rear, add(scale(f, x), scale(up, height)))


def rotate(v: Vector, yaw: float) -> Vector:
    """A direction in a frame turned about the vertical."""
    c, s = math.cos(yaw), math.sin(yaw)
    return c * v[0] - s * v[1], s * v[0] + c * v[1], v[2]


def rigid(position: Vector, yaw: float, translation: Sequence[float]) -> Vector:
    """A position in a turned and moved frame; directions are only turned."""
    return add(rotate(position, yaw), vector(*translation))


def quaternion(forward: Vector) -> dict[str, Column]:
    """x, y, z and w of the attitude without roll that points forward."""
    yaw, pitch = F.atan2(forward[1], forward[0]), -F.atan2(forward[2], F.hypot(forward[0], forward[1]))
    sy, cy, sp, cp = F.sin(yaw / 2), F.cos(yaw / 2), F.sin(pitch / 2), F.cos(pitch / 2)
    return {"qx": -sy * sp, "qy": cy * sp, "qz": sy * cp, "qw": cy * cp}


def arclength(points: DataFrame, by: list[str], order: str, axes: tuple[str, ...] = ("x", "y", "z"), least: float = 1e-6) -> DataFrame:
    """Points of a line with their running length s; points closer than ``least`` to the one before go."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), start=F.lit(0.0)))
    kept = points.withColumn("_d", step).where(F.col("_d").isNull() | (F.col("_d") >= least)).drop("_d")
    return kept.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def segments(route: DataFrame, by: list[str]) -> DataFrame:
    """A row for each segment of a line: s0, s1 and both ends."""
    w = Window.partitionBy(*by).orderBy("s")
    ends = route.select(*by, F.col("s").alias("s0"), F.lead("s").over(w).alias("s1"), *(c for a in "xyz" for c in (F.col(a).alias(f"{a}0"), F.lead(a).over(w).alias(f"{a}1"))))
    return ends.where("s1 is not null").withColumn("seg", F.row_number().over(Window.partitionBy(*by).orderBy("s0")))


def legendre_envelope(u: Column, order: int = 5) -> list[Column]:
    """Legendre polynomials of 2u - 1 under an envelope that is flat at both ends."""
    v, t = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)), None
    t = 2 * v - 1
    terms = [F.lit(1.0), t]
    for n in range(1, order):
        terms.append(((2 * n + 1) * t * terms[n] - n * terms[n - 1]) / (n + 1))
    envelope = 16 * v * v * (1 - v) * (1 - v)
    return [envelope * p for p in terms[: order + 1]]
