"""Joins in time, as windows over unions and as bucketed band joins.

A union with a window sorts each key once and needs no pair of rows in memory; band joins turn
into equi-joins on the tolerance's buckets, so no join here is a nested loop.  They merge, as
either side may be far larger than the planner takes it for.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import by_run


def _tagged(left: DataFrame, right: DataFrame, by: list[str], lt: str, rt: str) -> DataFrame:
    """Both sides in one table: by, _t, _side (1 left), _l and _r structs."""
    a = left.select(*by, F.col(lt).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("s")).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(rt).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    return a.union(b)


def _own(left: DataFrame, by: list[str]) -> list:
    """The left side's columns after _tagged; its keys by their own name, so that what is dealt by them stays so for the planner."""
    return [F.col(c) if c in by else F.col(f"_l.{c}") for c in left.columns]


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, prefix: str = "r_") -> DataFrame:
    """Each left row with the last right row of its key at or before its time (nulls if none)."""
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = _tagged(left, right, by, left_time, right_time).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return met.select(*_own(left, by), *(F.col(f"_m.{c}").alias(prefix + c) for c in right.columns if c not in by))


def asof_dual_clock(left: DataFrame, right: DataFrame, by: list[str], value: str = "value", header: str = "header", arrival: str = "arrival") -> DataFrame:
    """Each left row with the last right row that had arrived by its arrival and was measured by its header.

    The right side must be record-high, so headers and arrivals both grow along it and the
    earlier of the two last rows is the one that satisfies both clocks.
    """
    numbered = right.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(arrival, "id")))
    seen = F.struct(F.col("_i"), F.col(header).alias("header"), F.col(value).alias("value"))
    rows = numbered.select(*by, F.col(arrival).alias("_a"), F.col(header).alias("_h"), F.lit(0).alias("_side"), seen.alias("_r"))
    asks = left.select(*by, F.col(arrival).alias("_a"), F.col(header).alias("_h"), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    every = asks.unionByName(rows, allowMissingColumns=True)
    last = {c: F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(c, "_side").rowsBetween(Window.unboundedPreceding, 0)) for c in ("_a", "_h")}
    met = every.withColumn("_x", last["_a"]).withColumn("_y", last["_h"]).where("_side = 1")
    both = F.when(F.col("_x").isNull() | F.col("_y").isNull(), None).when(F.col("_x._i") < F.col("_y._i"), F.col("_x")).otherwise(F.col("_y"))
    return met.withColumn("_m", both).select("_l.*", F.col("_m.header").alias("r_header"), F.col("_m.value").alias("r_value"))


def _neighbours(every: DataFrame, by: list[str]) -> DataFrame:
    """Left rows with _p and _n, the last right row at or before their time and the first at or after it.

    Both frames grow row by row from one end of the key, so a key is read once each way.
    """
    ways = {"_p": F.col("_t").asc(), "_n": F.col("_t").desc()}
    seen = {c: F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(o, "_side").rowsBetween(Window.unboundedPreceding, 0)) for c, o in ways.items()}
    return every.withColumn("_p", seen["_p"]).withColumn("_n", seen["_n"]).where("_side = 1")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tolerance: int, prefix: str = "r_") -> DataFrame:
    """Each left row with the right row nearest in time, within ``tolerance`` (inclusive); of two as near the later."""
    met = _neighbours(_tagged(left, right, by, left_time, right_time), by)
    before, after = F.col("_t") - F.col(f"_p.{right_time}"), F.col(f"_n.{right_time}") - F.col("_t")
    chosen = F.when(F.col("_n").isNull() | (before < after), F.col("_p")).otherwise(F.col("_n"))
    near = met.withColumn("_m", chosen).withColumn("_m", F.when(F.abs(F.col(f"_m.{right_time}") - F.col("_t")) <= tolerance, F.col("_m")))
    return near.select(*_own(left, by), *(F.col(f"_m.{c}").alias(prefix + c) for c in right.columns if c not in by))


def interpolate(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the right side at its time: linear between rows, level beyond the ends."""
    met = _neighbours(_tagged(left, right.select(*by, right_time, value), by, left_time, right_time), by)
    t0, t1, v0, v1 = (F.col(f"{s}.{c}") for c in (right_time, value) for s in ("_p", "_n"))
    at = F.when(F.col("_p").isNull(), v1).when(F.col("_n").isNull() | (t0 == t1), v0).otherwise(v0 + (v1 - v0) * (F.col("_t") - t0) / (t1 - t0))
    return met.select(*_own(left, by), at.alias(f"{value}_at"))


def band_pairs(left: DataFrame, right: DataFrame, by: list[str], time: str, tolerance: int) -> DataFrame:
    """Each left row's nearest right row within ``tolerance``; a right row may serve several (the earlier of two as near)."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    a = left.select(*by, *(F.col(c).alias(f"a_{c}") for c in left.columns if c not in by)).withColumn("_b", bucket(f"a_{time}"))
    b = right.select(*by, *(F.col(c).alias(f"b_{c}") for c in right.columns if c not in by)).withColumn("_b", F.explode(F.sequence(bucket(f"b_{time}") - 1, bucket(f"b_{time}") + 1)))
    met = a.join(b.hint("merge"), [*by, "_b"]).where(F.abs(F.col(f"a_{time}") - F.col(f"b_{time}")) <= tolerance)
    best = Window.partitionBy(*by, f"a_{time}", "a_id").orderBy(F.abs(F.col(f"a_{time}") - F.col(f"b_{time}")), f"b_{time}", "b_id")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_b")


def nearest_pairs(rows: DataFrame, by: list[str], time: str, side: str, tolerance: int) -> DataFrame:
    """band_pairs() of the rows of side 0 with those of side 1, as windows over both: nothing is shuffled that is dealt by ``by`` already."""
    other = F.when(F.col(side) == 1, F.struct(*(c for c in rows.columns if c not in by)))
    ways = {"_p": F.col(time).asc(), "_n": F.col(time).desc()}
    seen = {c: F.last(other, ignorenulls=True).over(Window.partitionBy(*by).orderBy(o, F.col(side).desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)) for c, o in ways.items()}
    met = rows.withColumns(seen).where(F.col(side) == 0)
    before, after = F.col(time) - F.col(f"_p.{time}"), F.col(f"_n.{time}") - F.col(time)
    near = met.withColumn("_m", F.when(F.col("_n").isNull() | (before <= after), F.col("_p")).otherwise(F.col("_n"))).where(F.abs(F.col(f"_m.{time}") - F.col(time)) <= tolerance)
    names = [c for c in rows.columns if c not in (*by, side)]
    return near.select(*by, *(F.col(c).alias(f"a_{c}") for c in names), *(F.col(f"_m.{c}").alias(f"b_{c}") for c in names))


def link_exact(commands: DataFrame, predictions: DataFrame, by: list[str], stamp: str = "stamp") -> DataFrame:
    """Commands with the predictions of the same stamp; status tells missing, repeated and unordered ones.

    status: ok, missing (no prediction), duplicate (several), unordered (a prediction earlier
    than one written before it).
    """
    w = Window.partitionBy(*by).orderBy("id")
    checked = predictions.withColumn("_late", F.coalesce(F.col(stamp) < F.max(stamp).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    per = checked.groupBy(*by, stamp).agg(F.count(F.lit(1)).alias("n"), F.max("_late").alias("late"), F.min("value").alias("prediction"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("late"), "unordered").otherwise("ok")
    return commands.join(per, [*by, stamp], "left").withColumn("status", status).drop("n", "late")


def mismatches(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys that only one side has or whose values differ, nulls being equal: empty if both hold the same."""
    a, b = left.select(*key, F.struct(*values).alias("_a")), right.select(*key, F.struct(*values).alias("_b"))
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, F.col("_a").alias("left"), F.col("_b").alias("right"))


class Waiting:
    """Messages of one side that wait for a partner, by stamp; ``most`` at a time."""

    def __init__(self, most: int) -> None:
        self.most, self.stamps, self.held, self.taken = most, [], {}, 0
        self.overwritten = self.overflow = 0

    def put(self, stamp: int, item: object) -> None:
        """A stamp that waits already gets the new item and keeps its turn; beyond ``most`` the smallest stamp goes."""
        if stamp in self.held:
            self.overwritten += 1
            self.held[stamp] = self.held[stamp][0], item
            return
        self.taken += 1
        self.held[stamp] = self.taken, item
        insort(self.stamps, stamp)
        if len(self.stamps) > self.most:
            del self.held[self.stamps.pop(0)]
            self.overflow += 1

    def nearest(self, stamp: int, slop: int) -> int | None:
        """The stamp nearest to the given one and less than ``slop`` away; of two as near, the one that came first."""
        at = bisect_left(self.stamps, stamp)
        around = [s for s in self.stamps[max(at - 1, 0) : at + 1] if abs(s - stamp) < slop]
        return min(around, key=lambda s: (abs(s - stamp), self.held[s][0]), default=None)

    def take(self, stamp: int) -> object:
        del self.stamps[bisect_left(self.stamps, stamp)]
        return self.held.pop(stamp)[1]


class ApproximateSync:
    """One-use pairs of two streams whose stamps differ by less than ``slop``, as messages arrive."""

    def __init__(self, slop: int, queue: int = 100) -> None:
        self.slop, self.sides = slop, (Waiting(queue), Waiting(queue))

    def add(self, side: int, stamp: int, item: object) -> tuple[object, object] | None:
        """The pair that a message completes, if any; else it waits."""
        self.sides[side].put(stamp, item)
        mate = self.sides[1 - side].nearest(stamp, self.slop)
        if mate is None or stamp not in self.sides[side].held:
            return None
        met = {side: self.sides[side].take(stamp), 1 - side: self.sides[1 - side].take(mate)}
        return met[0], met[1]


def approx_sync(events: DataFrame, run: str, side: str, slop: int, queue: int = 100) -> DataFrame:
    """Pairs (run, first_id, second_id) of side 0 and side 1 messages of each run.

    events: run, side, stamp, arrival, id, none of them null.  The pairing depends on every
    earlier message of the run, so a run is read in order; what waits is bounded by ``queue``.
    """

    def make():
        sync = ApproximateSync(slop, queue)

        def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(b.column(c).to_pylist() for c in (side, "stamp", "id")), strict=True)
            found = [p for p in (sync.add(*r) for r in rows) if p]
            ids = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([b.column(run).take(pa.array(np.zeros(len(ids), int))), pa.array(ids[:, 0]), pa.array(ids[:, 1])], [run, "first_id", "second_id"])

        return pairs

    kind = events.schema[run].dataType.simpleString()
    return by_run(events.select(run, side, "stamp", "arrival", "id"), run, ["arrival", "id", side], make, f"{run} {kind}, first_id long, second_id long")


def publication_syncs(events: DataFrame, run: str, slop: int, latency: dict[str, int], queue: int = 100) -> DataFrame:
    """Pairs of each published quantity with the commands, each quantity on its own: run, quantity, command_id, id.

    events: run, kind (``command`` or a quantity of ``latency``), stamp, arrival, id.  A quantity
    arrives later by its latency; commands take part once for each quantity.
    """
    asked = events.where(F.col("kind") == "command").withColumn("quantity", F.explode(F.array(*(F.lit(q) for q in latency)))).withColumn("side", F.lit(0))
    late = F.element_at(F.create_map(*(F.lit(x) for q in latency.items() for x in q)), F.col("kind"))
    given = events.where(F.col("kind").isin(*latency)).withColumn("quantity", F.col("kind")).withColumn("side", F.lit(1)).withColumn("arrival", F.col("arrival") + late)
    keyed = asked.unionByName(given).withColumn("own", F.concat_ws("\x1f", F.col(run).cast("string"), "quantity"))
    pairs = approx_sync(keyed, "own", "side", slop, queue)
    names = keyed.select("own", run, "quantity").distinct()
    return pairs.join(names, "own").select(run, "quantity", F.col("first_id").alias("command_id"), F.col("second_id").alias("id"))


def merge_two_queues(left: DataFrame, right: DataFrame, by: list[str], stamp: str) -> DataFrame:
    """Both channels by stamp, the left one first of equals, numbered in that order."""
    every = left.withColumn("channel_no", F.lit(0)).unionByName(right.withColumn("channel_no", F.lit(1)))
    return every.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(stamp, "channel_no", "id")))
