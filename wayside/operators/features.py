"""The feature row: both wheels as last seen, their slopes and horizons, and the command's means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins, windows
from .ordering import record_high


@dataclass(frozen=True)
class Scales:
    """Time scales in the unit of the tables; the defaults fit microseconds of a vehicle."""

    unit: int = 1_000_000
    horizons: tuple[int, int, int] = (300_000, 1_000_000, 3_000_000)
    most_age: float = 10.0
    most_ahead: float = 0.3
    slope_limit: float = 4.0
    stale: float = 0.5


NAMES = (
    "front rear mean difference abs_difference front_age rear_age front_slope rear_slope front_slope_1 rear_slope_1 front_slope_2 rear_slope_2 front_slope_3 rear_slope_3 front_ahead rear_ahead mean_ahead "
    "command command_ema_1 command_ema_2 command_ema_3 front_lag_2 rear_lag_2 front_lag_3 rear_lag_3"
).split()


def _wheel(events: DataFrame, name: str, s: Scales) -> DataFrame:
    key, w = ["run_id"], record_high(events, ["run_id"])
    out = {"value": F.col("value"), "slope": windows.slope_short(key, "value", "header", s.slope_limit)}
    for k, h in enumerate(s.horizons, 1):
        out[f"slope_{k}"] = windows.slope_horizon(key, "value", "header", h, s.slope_limit)
        out[f"lag_{k}"] = windows.lag_horizon(key, "value", "header", h)
    return w.select("run_id", "id", "arrival", "header", F.struct(*(c.alias(k) for k, c in out.items())).alias("value"))


def rows(front: DataFrame, rear: DataFrame, commands: DataFrame, s: Scales = Scales()) -> DataFrame:
    """26 features for each command: what was known of both wheels when it came.

    All inputs: run_id, id, header, arrival, value.  A wheel not seen yet has zeros and the
    greatest age.
    """
    base = windows.ema(record_high(commands, ["run_id"]), "run_id", "value", "header", {f"command_ema_{k}": h / s.unit for k, h in enumerate(s.horizons, 1)}, s.unit)
    for name, wheel in (("front", front), ("rear", rear)):
        base = joins.asof_dual_clock(base, _wheel(wheel, name, s), ["run_id"]).withColumnsRenamed({"r_value": f"_{name}", "r_header": f"_{name}_at"})
    got = lambda name, c: F.coalesce(F.col(f"_{name}.{c}"), F.lit(0.0))
    age = lambda name: F.coalesce(F.least((F.col("header") - F.col(f"_{name}_at")) / s.unit, F.lit(s.most_age)), F.lit(s.most_age))
    out = {}
    for name in ("front", "rear"):
        out |= {name: got(name, "value"), f"{name}_age": age(name), f"{name}_slope": got(name, "slope")}
        out |= {f"{name}_slope_{k}": got(name, f"slope_{k}") for k in (1, 2, 3)}
        out |= {f"{name}_lag_{k}": got(name, f"lag_{k}") for k in (2, 3)}
        out[f"{name}_ahead"] = windows.extrapolate(got(name, "value"), age(name), got(name, "slope_1"), s.most_ahead)
    out |= {"mean": (out["front"] + out["rear"]) / 2, "difference": out["front"] - out["rear"], "abs_difference": F.abs(out["front"] - out["rear"]), "mean_ahead": (out["front_ahead"] + out["rear_ahead"]) / 2, "command": F.col("value")}
    return base.select("run_id", "id", "header", "arrival", *(F.col(n).alias(n) if n.startswith("command_") else out[n].cast("double").alias(n) for n in NAMES))
