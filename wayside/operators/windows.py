"""Windows over irregular time: horizon lags, slopes, recursions, integrals, bursts and regressions.

Time columns are integers (microseconds in the tables at hand).  Whatever a frame expresses is
a window function; the few true recursions are folds, written once and used for tables and
streams alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Arrays, Fold, along


def ordered(by: list[str], time: str = "t") -> Window:
    return Window.partitionBy(*by).orderBy(time)


def seconds(later: Column, earlier: Column, unit: int = 1_000_000) -> Column:
    """Integers are subtracted first, so no precision is lost on large stamps."""
    return (later - earlier) / unit


def clamp(c: Column, low: float, high: float) -> Column:
    """Limits a value; null and NaN stay null."""
    return F.when(c.isNull() | F.isnan(c), None).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def slope_short(by: list[str], value: str, time: str, limit: float, least_dt: float = 1e-6) -> Column:
    """Change per second since the row before; 0 for the first and for steps of no length."""
    w = ordered(by, time)
    dt = seconds(F.col(time), F.lag(time).over(w))
    return F.when(dt > least_dt, clamp((F.col(value) - F.lag(value).over(w)) / dt, -limit, limit)).otherwise(0.0)


def _lag_at(by: list[str], column: str, time: str, horizon: int) -> Column:
    w = ordered(by, time)
    within = w.rangeBetween(Window.unboundedPreceding, -horizon)
    return F.coalesce(F.last(column).over(within), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def lag_horizon(by: list[str], value: str, time: str, horizon: int) -> Column:
    """The last value at least ``horizon`` old, else the earliest there is."""
    return _lag_at(by, value, time, horizon)


def slope_horizon(by: list[str], value: str, time: str, horizon: int, limit: float) -> Column:
    """Change per second since the row that lag_horizon names."""
    dt = seconds(F.col(time), _lag_at(by, time, time, horizon))
    return F.when(dt > 1e-6, clamp((F.col(value) - _lag_at(by, value, time, horizon)) / dt, -limit, limit)).otherwise(0.0)


def extrapolate(value: Column, age: Column, slope: Column, most: float) -> Column:
    """The value carried forward by its slope for ``most`` seconds at most, never negative; null if any of the three is."""
    carried = value + F.when(age.isNotNull(), F.least(age, F.lit(most))) * slope
    return F.when(carried.isNotNull(), F.greatest(F.lit(0.0), carried))


def trapezoid(events: DataFrame, by: list[str], value: str, time: str, out: str = "distance") -> DataFrame:
    """The running integral of ``value`` over time."""
    w = ordered(by, time)
    part = F.coalesce((F.lag(value).over(w) + F.col(value)) / 2 * seconds(F.col(time), F.lag(time).over(w)), F.lit(0.0))
    return events.withColumn("_part", part).withColumn(out, F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_part")


def source_rate(events: DataFrame, by: list[str], value: str, source: str, time: str) -> DataFrame:
    """Rate between distinct source stamps; repeats of one stamp have no rate."""
    w = ordered(by, time)
    new = events.withColumn("_new", F.coalesce(F.col(source) > F.max(source).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))).where("_new").drop("_new")
    return new.withColumn("rate", (F.col(value) - F.lag(value).over(w)) / seconds(F.col(source), F.lag(source).over(w)))


def gap_flag(by: list[str], time: str, gap: int) -> Column:
    """True where more than ``gap`` has passed since the row before."""
    return F.coalesce(F.col(time) - F.lag(time).over(ordered(by, time)) > gap, F.lit(False))


def bursts(events: DataFrame, by: list[str], time: str, gap: int) -> DataFrame:
    """burst: 0, 1, .. along each key; a new one begins where more than ``gap`` has passed."""
    begins = gap_flag(by, time, gap).cast("int")
    return events.withColumn("_begins", begins).withColumn("burst", F.sum("_begins").over(ordered(by, time).rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def sliding(events: DataFrame, by: list[str], time: str, span: int, rows: int) -> DataFrame:
    """held: rows of the last ``span`` that are also among the last ``rows``, the own one included."""
    w = ordered(by, time)
    return events.withColumn("held", F.least(F.count(F.lit(1)).over(w.rangeBetween(-span, 0)), F.count(F.lit(1)).over(w.rowsBetween(-(rows - 1), 0))))


def moving_median(by: list[str], value: str, time: str, reach: int = 2) -> Column:
    """Median over ``reach`` rows on both sides; frames shrink at the ends."""
    return F.percentile(value, F.lit(0.5)).over(ordered(by, time).rowsBetween(-reach, reach))


def box_smooth(by: list[str], value: str, time: str, reach: int = 2) -> Column:
    """Mean over ``reach`` rows on both sides, the end rows repeated beyond the ends."""
    w = ordered(by, time)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = w.rowsBetween(-reach, reach)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before = F.greatest(F.lit(0), reach + 1 - place)
    after = F.greatest(F.lit(0), reach - (n - place))
    return (F.sum(value).over(frame) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / (2 * reach + 1)


def confirmed(by: list[str], test: Column, time: str, times: int = 3) -> Column:
    """True where ``test`` holds on this row and the ``times`` - 1 before it."""
    frame = ordered(by, time).rowsBetween(-(times - 1), 0)
    held = F.when(test, 1).otherwise(0)
    return (F.count(F.lit(1)).over(frame) == times) & (F.min(held).over(frame) == 1)


def regression(events: DataFrame, by: list[str], x: str, y: str, time: str, rows: int) -> DataFrame:
    """slope and intercept of y on x over the last ``rows`` rows; null where x does not vary."""
    frame = ordered(by, time).rowsBetween(-(rows - 1), 0)
    spread = F.var_pop(x).over(frame)
    slope = F.when(F.count(F.lit(1)).over(frame) > 1, F.when(spread > 1e-12, F.covar_pop(x, y).over(frame) / spread))
    return events.withColumn("slope", slope).withColumn("intercept", F.avg(y).over(frame) - F.col("slope") * F.avg(x).over(frame))


def course(events: DataFrame, by: list[str], way: str, x: str, y: str, time: str, rows: int, span: int, least_rows: int = 5, least_span: float = 5.0, gain: tuple[float, float] = (0.8, 1.2), worst: float = 1.0, rms: float = 0.5) -> DataFrame:
    """The course that the last rows of a key agree on: the regression of place on way, and whether its tests hold.

    Of at most ``rows`` rows not older than ``span``: course_n, gain_x and gain_y (metres of place for a
    metre of way), gain (their size), rms and worst (of what the regression leaves) and sound, which asks
    for enough rows, a way of ``least_span``, a gain near one and small residuals.  Residuals are of the
    window's own regression, so each row looks at its window twice; null where way does not vary.
    """
    frame = ordered(by, time).rowsBetween(-(rows - 1), 0)
    held = F.filter(F.collect_list(F.struct(F.col(time).alias("t"), F.col(way).cast("double").alias("d"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).over(frame), lambda e: e["t"] >= F.col(time) - span)
    seen = events.withColumn("_e", held).withColumn("course_n", F.size("_e"))
    total = lambda f: F.aggregate("_e", F.lit(0.0), lambda a, e: a + f(e))
    middle = seen.withColumns({f"_{c}": total(lambda e, c=c: e[c]) / F.col("course_n") for c in "dxy"})
    off = lambda e, c: e[c] - F.col(f"_{c}")
    spread = middle.withColumns({"_v": total(lambda e: off(e, "d") * off(e, "d")), **{f"_c{c}": total(lambda e, c=c: off(e, "d") * off(e, c)) for c in "xy"}})
    fitted = spread.withColumns({f"gain_{c}": F.when(F.col("_v") > 1e-12, F.col(f"_c{c}") / F.col("_v")) for c in "xy"}).withColumn("gain", F.hypot("gain_x", "gain_y"))
    miss = F.transform("_e", lambda e: F.hypot(off(e, "x") - F.col("gain_x") * off(e, "d"), off(e, "y") - F.col("gain_y") * off(e, "d")))
    judged = fitted.withColumn("_m", miss).withColumns({"rms": F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, m: a + m * m) / F.col("course_n")), "worst": F.array_max("_m"), "_way": F.get("_e", F.col("course_n") - 1)["d"] - F.get("_e", F.lit(0))["d"]})
    tests = (F.col("course_n") >= least_rows) & (F.col("_way") >= least_span) & F.col("gain").between(*gain) & (F.col("worst") <= worst) & (F.col("rms") <= rms)
    return judged.withColumn("sound", F.coalesce(tests, F.lit(False))).drop("_e", "_d", "_x", "_y", "_v", "_cx", "_cy", "_m", "_way")


def first_window(events: DataFrame, by: list[str], header: str, arrival: str, span: int) -> DataFrame:
    """Rows measured and arrived within ``span`` of the key's first header."""
    first = F.min(header).over(Window.partitionBy(*by))
    return events.withColumn("_first", first).where((F.col(header) <= F.col("_first") + span) & (F.col(arrival) <= F.col("_first") + span)).drop("_first")


def decayed(total: Column, anchor: Column, length: float) -> Column:
    """What is left of a correction after the way travelled since its anchor."""
    return F.exp(-(total - anchor) / length)


def ema_fold(value: str, time: str, taus: dict[str, float], unit: int = 1_000_000) -> Fold:
    """Exponential means for uneven steps, one for each time constant in seconds; the first sample is the mean."""

    def start(n: int) -> Arrays:
        return {"begun": np.zeros(n, bool), "t": np.zeros(n, np.int64), **{k: np.zeros(n) for k in taus}}

    def step(s: Arrays, x: Arrays) -> Arrays:
        # Whole stamps are subtracted first; only the step passes through a double.
        dt = np.where(s["begun"], x[time] - s["t"], 0) / unit
        for k, tau in taus.items():
            s[k][...] = np.where(s["begun"], x[value] + np.exp(-dt / tau) * (s[k] - x[value]), x[value])
        s["t"][...], s["begun"][...] = x[time], True
        return {k: s[k].copy() for k in taus}

    return Fold(start, step, (value, time), dict.fromkeys(taus, "double"))


def ema(events: DataFrame, by: str, value: str, time: str, taus: dict[str, float], unit: int = 1_000_000) -> DataFrame:
    return along(events, by, [time], ema_fold(value, time, taus, unit))


def spacing_fold(time: str, least: int) -> Fold:
    """Keeps rows at least ``least`` after the last kept one; the first is kept."""

    def step(s: Arrays, x: Arrays) -> Arrays:
        take = ~s["begun"] | (x[time] - s["kept"] >= least)
        s["kept"][...] = np.where(take, x[time], s["kept"])
        s["begun"][...] = True
        return {"take": take}

    return Fold(lambda n: {"begun": np.zeros(n, bool), "kept": np.zeros(n, np.int64)}, step, (time,), {"take": "boolean"}, "take")


def greedy_spacing(events: DataFrame, by: str, time: str, least: int) -> DataFrame:
    """Rows at least ``least`` after the last kept row of their key; the first is kept."""
    return along(events, by, [time], spacing_fold(time, least))


def record_high_fold(header: str = "header") -> Fold:
    """Rows whose header exceeds all before; late and repeated ones go.  For streams; tables have a window for it."""

    def step(s: Arrays, x: Arrays) -> Arrays:
        take = ~s["begun"] | (x[header] > s["last"])
        s["last"][...] = np.where(take, x[header], s["last"])
        s["begun"][...] = True
        return {"take": take}

    return Fold(lambda n: {"begun": np.zeros(n, bool), "last": np.zeros(n, np.int64)}, step, (header,), {"take": "boolean"}, "take")
