"""Predicates and scalar rules of the signals, as column expressions with nulls spelled out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.aggregates import finite
from ..schema import FLAGS, Settings

S = Settings()


def wheel_valid(channel: Column, raw: Column, stamp: Column, arrival: Column, unit: int, s: Settings = S) -> Column:
    """A wheel sample that may be used: known channel, plausible speed, not from the future."""
    test = channel.isin(0, 1) & finite(raw) & (raw >= 0) & (raw <= s.max_speed * s.wheel_divisor) & (stamp > 0) & (stamp <= arrival + int(s.future_tolerance * unit))
    return F.coalesce(test, F.lit(False))


def command_valid(position: Column, stamp: Column, arrival: Column, unit: int, s: Settings = S) -> Column:
    return F.coalesce(position.between(-15, 15) & (stamp <= arrival + int(s.future_tolerance * unit)), F.lit(False))


def fix_valid(lat: Column, lon: Column, alt: Column, status: Column, stamp: Column, arrival: Column, unit: int, s: Settings = S) -> Column:
    test = (status >= 0) & finite(lat) & finite(lon) & finite(alt) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & (stamp <= arrival + int(s.future_tolerance * unit))
    return F.coalesce(test, F.lit(False))


def command_or_zero(command: Column, age: Column, s: Settings = S) -> Column:
    """A command too old, or none, counts as zero."""
    return F.when(command.isNull() | age.isNull() | (age > s.stale_command), 0).otherwise(command)


def metres_per_second(raw: Column, s: Settings = S) -> Column:
    return raw / s.wheel_divisor


def mask(tests: dict[str, Column]) -> Column:
    """The bits of FLAGS whose tests hold; null tests do not."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(t, FLAGS[k]).otherwise(0) for k, t in tests.items()))


def has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def baseline_good(distance: Column, gap: Column, unit: int, low: float = 11.9, high: float = 12.9, tolerance: float = 0.05) -> Column:
    """Antenna pairs whose distance and time gap are believable."""
    return F.coalesce((distance > low) & (distance < high) & (gap <= int(tolerance * unit)), F.lit(False))


def sparse_burst(elapsed: Column, offset: float, head: float = 3.0, period: float = 120.0, length: float = 1.0) -> Column:
    """The first seconds, and from ``offset`` on one burst in each period."""
    return (elapsed <= head) | ((elapsed >= offset) & (F.pmod(elapsed - offset, F.lit(period)) < length))


def phases(elapsed: Column, flags: Column, startup: float = 3.0) -> dict[str, Column]:
    """Masks by which errors are reported."""
    ready = ~has(flags, "not_initialized")
    return {"every": F.lit(True), "startup": elapsed < startup, "after_startup": elapsed >= startup, "initialized": ready, "initialized_after_startup": ready & (elapsed >= startup)}


def training_row(age_front: Column, age_rear: Column, difference: Column, slope_difference: Column, speed: Column, slope: Column, elapsed: Column) -> Column:
    """Rows from which a drive model may learn."""
    return F.coalesce((age_front < 0.3) & (age_rear < 0.3) & (F.abs(difference) < 0.15) & (F.abs(slope_difference) < 0.25) & (speed > 0.3) & (F.abs(slope) < 1.8) & (elapsed > 5), F.lit(False))


def drive_basis(command: Column, speed: Column) -> dict[str, Column]:
    """Nine terms of specific force from a command of -15 to 15 and a speed."""
    pull, brake, v = F.greatest(command, F.lit(0)) / 15, F.least(command, F.lit(0)) / 15, speed / 15
    terms = (pull, brake, pull * pull, brake * brake, pull * v, brake * v, F.tanh(speed / 0.3), v, v * v)
    return {f"b{k}": t for k, t in enumerate(terms)}


def fresh_baseline(front: Column, rear: Column, age_front: Column, age_rear: Column, s: Settings = S) -> Column:
    """The mean of fresh wheels, the only fresh one, or the younger one; never negative."""
    f, r = age_front < s.freshness, age_rear < s.freshness
    chosen = F.when(f & r, (front + rear) / 2).when(f, front).when(r, rear).when(age_front <= age_rear, front).otherwise(rear)
    return F.greatest(chosen, F.lit(0.0))


def position_sigma(distance: Column, init_rms: Column, flags: Column) -> Column:
    """A cautious standard deviation along the way, not a calibrated one."""
    base = 1 + 0.003 * distance + init_rms + F.when(has(flags, "not_initialized"), 10).otherwise(0) + F.when(has(flags, "front_distrust") | has(flags, "rear_distrust"), 3).otherwise(0) + F.when(has(flags, "degraded_init"), 5).otherwise(0)
    lost = F.when(has(flags, "off_map") | has(flags, "rejoining"), F.greatest(base, F.lit(10.0))).otherwise(base)
    return F.when(has(flags, "pair_conflict"), F.greatest(lost, F.lit(25.0))).otherwise(lost)
