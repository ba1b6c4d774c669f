"""Schemas of the event tables and the settings of the estimators."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import types as T

NS = 1_000_000_000

#: One row for each message.  Stamps are integer nanoseconds and never pass through a double.
EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("stamp", T.LongType(), False),
        T.StructField("arrival", T.LongType(), False),
        T.StructField("id", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("lla", T.ArrayType(T.DoubleType())),
        T.StructField("status", T.IntegerType()),
    ]
)

# Fixed values, here and in FLAGS and the defaults of Settings: columns, bits and limits as files and vehicles have them.
PREDICTION_COLUMNS = ("stamp", "velocity", "bogie_velocity", "distance", "route_s", "x", "y", "z", "flags", "route", "init_rms", "mx", "my", "mz", "vx", "vy", "vz", "wx", "wy", "wz")
PREDICTION = T.StructType([T.StructField(c, T.LongType() if c in ("stamp", "flags", "route") else T.DoubleType(), False) for c in PREDICTION_COLUMNS])

ROUTE = T.StructType([T.StructField(c, T.DoubleType(), False) for c in ("s", "x", "y", "z")])

#: Bits of the output mask.
FLAGS = {
    "front_distrust": 1,
    "rear_distrust": 2,
    "outside_map": 4,
    "not_initialized": 8,
    "init_window": 16,
    "degraded_init": 32,
    "stale_command": 64,
    "output_gap": 128,
    "off_map": 256,
    "rejoining": 512,
    "pair_conflict": 1024,
    "slip": 2048,
}


@dataclass(frozen=True)
class Settings:
    """Limits and gains; construction fails on values that make no sense together."""

    wheel_divisor: float = 3.6
    max_speed: float = 40.0
    future_tolerance: float = 0.05
    stale_command: float = 0.5
    init_seconds: float = 3.0
    pair_tolerance: float = 0.05
    fix_max_age: float = 1.0
    baseline: float = 12.436
    baseline_strict: float = 0.5
    degraded_share: float = 0.25
    init_cost: float = 400.0
    residual_gate: float = 8.0
    innovation_gate: float = 30.0
    phase_gain: float = 0.25
    phase_step: float = 5.0
    bias_decay: float = 100.0
    residual_bias: bool = True
    freshness: float = 0.35
    gap_seconds: float = 0.5
    origin_lat: float = 55.805
    origin_lon: float = 37.425
    origin_alt: float = 170.0
    antenna_front: float = 2.563
    antenna_rear: float = -9.873
    antenna_height: float = 3.0
    chord: float = 7.55
    speed_scale: float = 1.0
    corrects: bool = True
    allow_degraded: bool = True
    align_initial_position: bool = False
    output_x: float = 0.0
    output_z: float = 0.0
    velocity_x: float = -9.873
    velocity_z: float = 3.0
    compensate_lever_arm: bool = False
    #: Metres off the map from which on a run may have left it; 0: runs never do.
    departure: float = 0.0
    departure_angle: float = 10.0
    least_span: float = 5.0
    evidence_seconds: float = 3.0
    bridge_most: float = 100.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if not math.isfinite(getattr(self, f.name)):
                raise ValueError(f"{f.name} is not finite")
        for name in ("wheel_divisor", "max_speed", "init_seconds", "pair_tolerance", "fix_max_age", "init_cost", "residual_gate", "innovation_gate", "phase_step", "bias_decay", "freshness", "gap_seconds", "chord"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.phase_gain <= 1 or not 0 <= self.degraded_share < 1:
            raise ValueError("phase_gain and degraded_share are shares")
        if self.init_seconds > 30:
            raise ValueError("the first window is no longer than half a minute")
        if not 0.9 <= self.speed_scale <= 1.1:
            raise ValueError("speed_scale lies beyond what wheels are calibrated for")
        if min(self.departure, self.departure_angle, self.least_span, self.evidence_seconds, self.bridge_most) < 0:
            raise ValueError("limits of departures are not negative")
        if self.future_tolerance < 0:
            raise ValueError("the tolerance is not negative")
        if self.residual_gate > self.innovation_gate:
            raise ValueError("the residual gate lies within the innovation gate")
        if abs(self.origin_lat) > 90 or abs(self.origin_lon) > 180:
            raise ValueError("the origin is not on the globe")
        if self.antenna_front <= self.antenna_rear:
            raise ValueError("the front antenna lies before the rear one")
