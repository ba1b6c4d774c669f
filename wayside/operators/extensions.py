"""Ends of a line lengthened by what runs travelled beyond them: even steps, a short mean, and a join without a leap.

All steps are joins and windows over a run's own points, so runs go side by side; a point is a
row (run, at, its coordinates) with ``at`` the way travelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE, AFTER = "before", "after"


def even_steps(points: DataFrame, run: str, at: str, columns: list[str], step: float, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """run, i, at and columns every ``step`` from ``low`` (included) to ``high`` (not), straight between a run's neighbouring points.

    low, high: expressions over a run's own columns of ``points`` (constant in a run), by default the first and last ``at``.
    Before the first and after the last point its values hold.  Of points with equal ``at`` the greatest values count (in the
    order of ``columns``); rows with a null or NaN do not.  A run of one point, or with ``low`` not under ``high``, gives no row.
    """
    real = [F.col(c).cast("double").alias(c) for c in columns]
    bounds = [(F.lit(None) if b is None else b).cast("double").alias(n) for n, b in (("_low", low), ("_high", high))]
    known = points.select(run, F.col(at).cast("double").alias(at), *real, *bounds).dropna(subset=[at, *columns]).where(F.lit(True) if not columns else ~F.greatest(*(F.isnan(c) for c in [at, *columns])))
    one = known.groupBy(run, at).agg(F.max(F.struct(*columns)).alias("here"), F.first("_low", ignorenulls=True).alias("_low"), F.first("_high", ignorenulls=True).alias("_high"))
    # Each point with the next one; the steps from one to the next are made in place, so a run is sorted once and no step is shuffled.
    w, whole = Window.partitionBy(run).orderBy(at), Window.partitionBy(run).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spot = F.struct(F.col(at).alias("at"), F.col("here").alias("p"))
    bound = {"low": F.coalesce(F.first("_low", ignorenulls=True).over(whole), F.first(at).over(whole)), "high": F.coalesce(F.first("_high", ignorenulls=True).over(whole), F.last(at).over(whole))}
    pairs = one.withColumns({**bound, "_b": spot, "_a": F.lead(spot).over(w), "_begins": F.row_number().over(w) == 1})
    # The number of steps as an even range has it: what is left over makes one more.
    count = F.ceil((F.col("high") - F.col("low")) / step - 1e-9)
    # A step more on each side than division tells; which of them lie between the two points is judged by their own places.
    low_i = F.when(F.col("_begins"), F.lit(0)).otherwise(F.greatest(F.floor((F.col("_b.at") - F.col("low")) / step) - 1, F.lit(0)))
    high_i = F.when(F.col("_a").isNull(), count - 1).otherwise(F.least(F.ceil((F.col("_a.at") - F.col("low")) / step) + 1, count - 1))
    many = pairs.where((count > 0) & ~(F.col("_begins") & F.col("_a").isNull())).withColumns({"_from": low_i.cast("long"), "_to": high_i.cast("long")}).where("_from <= _to")
    steps = many.select(run, "_a", "_b", "_begins", "low", F.explode(F.sequence("_from", "_to")).alias("i")).withColumn(at, F.col("low") + F.col("i") * step)
    met = steps.where((F.col("_begins") | (F.col(at) >= F.col("_b.at"))) & (F.col("_a").isNull() | (F.col(at) < F.col("_a.at"))))
    share = (F.col(at) - F.col("_b.at")) / (F.col("_a.at") - F.col("_b.at"))
    value = lambda c: F.when((F.col("_b.at") >= F.col(at)) | F.col("_a").isNull(), F.col(f"_b.p.{c}")).otherwise(F.col(f"_b.p.{c}") + (F.col(f"_a.p.{c}") - F.col(f"_b.p.{c}")) * share)
    return met.select(run, "i", at, *(value(c).alias(c) for c in columns))


def short_mean(rows: DataFrame, run: str, order: str, columns: list[str], reach: int = 2) -> DataFrame:
    """Each value becomes the mean of itself and ``reach`` rows on each side; beyond a run's ends its end values stand."""
    w, whole = Window.partitionBy(run).orderBy(order), Window.partitionBy(run)
    near = w.rowsBetween(-reach, reach)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    missing = {"first": F.greatest(reach + 1 - place, F.lit(0)), "last": F.greatest(place + reach - n, F.lit(0))}
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    padded = lambda c: (F.sum(c).over(near) + missing["first"] * F.first(c).over(ends) + missing["last"] * F.last(c).over(ends)) / (2 * reach + 1)
    return rows.withColumns({c: padded(c) for c in columns})


def join_end(rows: DataFrame, run: str, order: str, columns: list[str], target: dict[str, Column], side: str, most: int = 25) -> DataFrame:
    """Moves a run's rows so that the one at the join meets ``target``, and leaves that one out, as the line has it.

    side: BEFORE for what leads to the line (its last row joins), AFTER for what goes on from it (its first).  The shift
    fades evenly over ``most`` rows, or over all of a shorter run; a run of one row is but the join.
    """
    w = Window.partitionBy(run).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(Window.partitionBy(run))
    from_join = (n - F.row_number().over(w)) if side == BEFORE else (F.row_number().over(w) - 1)
    fade = F.least(n, F.lit(most))
    end = F.last if side == BEFORE else F.first
    shifts = {f"_d_{c}": target[c] - end(c).over(whole) for c in columns}
    placed = rows.withColumns({"_k": from_join, "_m": fade, **shifts})
    weight = F.when(F.col("_m") > 1, F.greatest(1 - F.col("_k") / F.nullif(F.col("_m") - 1, F.lit(0)), F.lit(0.0))).otherwise(F.lit(1.0))
    return placed.withColumns({c: F.col(c) + weight * F.col(f"_d_{c}") for c in columns}).where("_k > 0").drop("_k", "_m", *shifts)


def lengthened(points: DataFrame, run: str, at: str, columns: list[str], begin: Column, end: Column, places: DataFrame, first: dict[str, Column], last: dict[str, Column], step: float = 1.0, least: int = 5) -> DataFrame:
    """run, side, i, at and columns of what lies before and after a line, for each run that travelled it and beyond.

    begin, end: the way travelled at the line's two ends (constant in a run); first, last: where the line has them, over
    the columns of ``places`` (a row a run).  Points up to ten
    steps inside the line count too, so that the join is between points.  Sides with fewer than ``least`` points or two steps have no row.
    """
    sided = []
    for side in (BEFORE, AFTER):
        near = points.where(F.col(at) < begin + 10 * step) if side == BEFORE else points.where(F.col(at) > end - 10 * step)
        enough = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(run))).where(F.col("_n") >= least)
        bounded = enough.withColumns({"_from": F.greatest(F.min(at).over(Window.partitionBy(run)), F.lit(0.0)) if side == BEFORE else end + step, "_to": begin if side == BEFORE else F.max(at).over(Window.partitionBy(run))})
        even = even_steps(bounded, run, at, columns, step, F.col("_from"), F.col("_to"))
        smooth = short_mean(even, run, "i", columns)
        more = smooth.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(run))).where("_n >= 2").drop("_n")
        sided.append(join_end(more.join(places, run), run, "i", columns, first if side == BEFORE else last, side).withColumn("side", F.lit(side)))
    return sided[0].unionByName(sided[1]).select(run, "side", "i", at, *columns)
