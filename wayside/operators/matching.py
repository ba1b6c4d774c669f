"""Points matched to segments of lines that no task could hold, through a grid that proves its answers.

Segments are cut to pieces no longer than a cell and stand in the cell of their middle.  A point
meets the pieces of the nine cells around it; a piece elsewhere is further off than the side of a
cell less half a piece.  Points whose last wanted match is nearer than that are done, the others go
on with cells twice as large, until none is left.  Only what lies around a point is cut: pieces are
made sixteen times shorter at a time, and those that no point asks for go before the next cut.  The
points and the pieces of a cell are dealt to tiles of bounded size, each of which keeps the best of
its pairs, so pairs are never shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Weight of a heading against a distance in metres: squared, times one less the cosine.
HEADING = 25.0
#: Points and pieces of a tile, about; pairs of them that are held at once; how much shorter a cut makes pieces.
TILE, HELD, FINER = 2048, 1 << 19, 16


def segments_of(vertices: DataFrame, route: str = "route", order: str = "k") -> DataFrame:
    """route, segment, s, and x0 .. z1 of the lines through vertices (route, k, x, y, z); vertices on one spot make no segment.

    s: the way from the line's start to the segment's.
    """
    w = Window.partitionBy(route).orderBy(order)
    ends = vertices.select(F.col(route).alias("route"), F.col(order).alias("segment"), *(F.col(c).alias(f"{c}0") for c in "xyz"), *(F.lead(c).over(w).alias(f"{c}1") for c in "xyz")).where("x1 is not null")
    length = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in "xyz"), start=F.lit(0.0)))
    sized = ends.withColumn("length", length).where("length > 1e-6")
    before = F.sum("length").over(Window.partitionBy("route").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return sized.withColumn("s", F.coalesce(before, F.lit(0.0)))


def _cut(pieces: DataFrame, length: float) -> DataFrame:
    """Pieces from share _a to share _b of their segment, cut to at most ``length`` in the plane, with the middle (_mx, _my) of each."""
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * (F.col("_b") - F.col("_a")) / length), F.lit(1))
    share = lambda i: F.col("_a") + (F.col("_b") - F.col("_a")) * i / F.col("_n")
    cut = pieces.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumns({"_a": share(F.col("_i") - 1), "_b": share(F.col("_i"))})
    middle = {c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col("_a") + F.col("_b")) / 2 for c in "xy"}
    return cut.withColumns({f"_m{c}": v for c, v in middle.items()}).drop("_n", "_i")


def _cells(x: str, side: float) -> list[Column]:
    return [F.floor(F.col(f"{x}{c}") / side).cast("long").alias(f"_c{c}") for c in "xy"]


def _around(cells: DataFrame) -> DataFrame:
    """Each row in the nine cells around its own."""
    near = F.array(*(F.struct((F.col("_cx") + i).alias("_cx"), (F.col("_cy") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return cells.withColumn("_near", F.explode(near)).drop("_cx", "_cy").select("*", "_near.*").drop("_near")


def _near(segments: DataFrame, asked: DataFrame, edge: float, length: float, longest: float) -> DataFrame:
    """The pieces of at most ``length`` around cells that are asked for, in each of those cells.

    Parts of a piece have their middles within half of it, so a piece no longer than a coarse cell is needed only around asked ones.
    """
    pieces = segments.withColumns({"_a": F.lit(0.0), "_b": F.lit(1.0)})
    coarse = 1
    while coarse * edge < longest:
        coarse *= FINER
    while coarse > 1:
        wanted = _around(asked.select(*(F.floor(F.col(c) / coarse).cast("long").alias(c) for c in ("_cx", "_cy"))).distinct()).distinct()
        pieces = _cut(pieces, coarse * edge).select("*", *_cells("_m", coarse * edge)).join(wanted, ["_cx", "_cy"], "left_semi").drop("_cx", "_cy", "_mx", "_my")
        coarse //= FINER
    return _around(_cut(pieces, length).select("*", *_cells("_m", edge)).drop("_mx", "_my"))


def _best(best: int, flat: bool, heading: bool, sure: float, least: int, schema: pa.Schema):
    """For the points and the pieces of a tile the ``best`` segments of each point, and whether they are proven if the cell has one tile of pieces."""
    axes = 2 if flat else 3

    def ranked(points: pa.Table, pieces: pa.Table) -> pa.Table:
        if not points.num_rows or not pieces.num_rows:
            return schema.empty_table()
        pieces = pieces.sort_by([("route", "ascending"), ("segment", "ascending"), ("_a", "ascending")])
        n = pieces.num_rows
        new = np.ones(n, bool)  # pieces of one segment are one match
        names = list(zip(pieces["route"].to_pylist(), pieces["segment"].to_pylist(), strict=True))
        new[1:] = [a != b for a, b in zip(names, names[1:], strict=False)]
        first = np.flatnonzero(new)
        x = {c: pieces[c].to_numpy() for c in ("s", "length", "_a", "_b", *(f"{c}{k}" for c in "xyz" for k in "01"))}
        way = [x[f"{c}1"] - x[f"{c}0"] for c in "xyz"]
        square = np.maximum(sum(w * w for w in way[:axes]), 1e-12)
        place, toward = ([points[f"{p}{c}"].to_numpy() for c in "xyz"] if p == "p" or heading else None for p in "ph")
        whole = points["_pieces"][0].as_py() == 1
        out = []
        for k in range(0, points.num_rows, max(1, HELD // n)):
            few = slice(k, k + max(1, HELD // n))
            p = [c[few, None] for c in place]
            share = np.clip(sum((p[j] - x[f"{c}0"]) * way[j] for j, c in enumerate("xyz"[:axes])) / square, x["_a"], x["_b"])
            apart = sum((x[f"{c}0"] + share * way[j] - p[j]) ** 2 for j, c in enumerate("xyz"[:axes]))
            cost = apart + HEADING * (1 - sum(w / x["length"] * t[few, None] for w, t in zip(way, toward, strict=True))) ** 2 if heading else apart
            low = np.minimum.reduceat(cost, first, axis=1)
            order = np.argsort(low, axis=1, kind="stable")[:, :best]  # segments stand by route and number, so equal costs do too
            row, rank = np.divmod(np.arange(order.size), order.shape[1])
            group = order.ravel()
            value = low[row, group]
            at, end = first[group], np.append(first[1:], n)[group]
            for _ in range(int(np.diff(np.append(first, n)).max()) - 1):  # the pieces of a segment are few
                at = np.where((cost[row, at] > value) & (at + 1 < end), at + 1, at)
            last = low[np.arange(len(order)), order[:, -1]]
            proven = whole & (order.shape[1] >= least) & (last <= sure * sure)
            given = {"id": points["id"].slice(k, len(order)).take(pa.array(row)), "rank": pa.array((rank + 1).astype(np.int32)), **{c: pieces[c].take(pa.array(at)) for c in ("route", "segment")}}
            numbers = {"s": x["s"][at] + share[row, at] * x["length"][at], "distance": np.sqrt(apart[row, at]), "cost": value, "_proven": proven[row], "_whole": np.full(len(row), whole)}
            out.append(pa.table(given | {c: pa.array(v) for c, v in numbers.items()}).select(schema.names).cast(schema))
        return pa.concat_tables(out)

    return ranked


def match(points: DataFrame, segments: DataFrame, cell: float, folder: str, best: int = 8, flat: bool = True) -> DataFrame:
    """id, rank (from 1), route, segment, s, distance and cost of the ``best`` segments of each point, by cost, then route and segment.

    points: id (told apart), px, py, pz, and, if headings count, hx, hy, hz (unit vectors).
    segments: as of segments_of().  cell: about as large as points are usually off their line.
    folder: where each round's undecided points are written; rounds are few, as cells double.
    Points without a place (null, no number or infinite) have no match; without segments there is none.
    """
    spark = points.sparkSession
    heading = "hx" in points.columns
    own = ["id", "px", "py", "pz", *(["hx", "hy", "hz"] if heading else [])]
    size = segments.agg(F.count(F.lit(1)).alias("n"), F.max(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("longest")).first()
    left = points.select(*own).dropna().where((F.abs("px") < 1e12) & (F.abs("py") < 1e12) & ~F.isnan("pz"))
    done: list[DataFrame] = []
    edge, least = cell, min(best, size.n)
    blank = points.limit(0).join(segments.select("route", "segment").limit(0)).select("id", F.lit(1).alias("rank"), "route", "segment", *(F.lit(0.0).alias(c) for c in ("s", "distance", "cost")), F.lit(True).alias("_proven"), F.lit(True).alias("_whole"))
    columns = ["id", "rank", "route", "segment", "s", "distance", "cost"]
    while size.n:
        path, cells_path, near_path, left_path = (f"{folder}/{uuid.uuid4().hex}" for _ in range(4))
        length = cell if edge == cell else edge / 2
        sure = edge - length / 2  # pieces reach half their length
        left.select(*_cells("p", edge)).groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_asked")).write.parquet(cells_path)
        asked = spark.read.parquet(cells_path)
        _near(segments, asked.select("_cx", "_cy"), edge, length, size.longest).join(asked.select("_cx", "_cy"), ["_cx", "_cy"], "left_semi").write.parquet(near_path)
        met = spark.read.parquet(near_path)
        # Tiles: all pieces of a segment go to one, points and pieces to as many as they need.
        tiles = asked.join(met.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_met")), ["_cx", "_cy"]).select("_cx", "_cy", F.ceil(F.col("_asked") / TILE).alias("_points"), F.ceil(F.col("_met") / TILE).alias("_pieces"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        by = ["_cx", "_cy", "_pt", "_st"]
        dealt = left.select("*", *_cells("p", edge)).join(tiles, ["_cx", "_cy"]).withColumn("_pt", F.pmod(F.xxhash64("id"), F.col("_points"))).withColumn("_st", every("_pieces")).select(*by, *own, "_pieces")
        cut = met.join(tiles, ["_cx", "_cy"]).withColumn("_st", F.pmod(F.xxhash64("route", "segment"), F.col("_pieces"))).withColumn("_pt", every("_points"))
        cut = cut.select(*by, "route", "segment", "s", "length", "_a", "_b", *(f"{c}{k}" for c in "xyz" for k in "01"))
        schema = to_arrow_schema(blank.schema)
        held = dealt.groupBy(*by).cogroup(cut.groupBy(*by)).applyInArrow(_best(best, flat, heading, sure, least, schema), blank.schema)
        held.write.parquet(path)
        round_ = spark.read.parquet(path)
        # Cells of several tiles of pieces: the best of all of them.
        several = round_.where("not _whole").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("cost", "route", "segment"))).where(F.col("rank") <= best)
        last = F.max(F.struct("rank", "cost")).over(Window.partitionBy("id"))
        judged = several.withColumn("_last", last).withColumn("_proven", (F.col("_last.rank") >= least) & (F.col("_last.cost") <= sure * sure)).drop("_last")
        proven = round_.where("_whole and _proven").unionByName(judged.where("_proven")).select(*columns)
        done.append(proven)
        left.join(proven.where("rank = 1").select("id"), "id", "left_anti").write.parquet(left_path)
        left = spark.read.parquet(left_path)
        if left.isEmpty():
            break
        edge *= 2
    if not done:
        return blank.select(*columns)
    return reduce(DataFrame.unionByName, done)
