"""Text, binary, CSV and JSON files of events, predictions, routes and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import PREDICTION, PREDICTION_COLUMNS, ROUTE

#: Kinds of event lines with one number, with a whole number, with four numbers, and with none.
REAL, WHOLE, FIX, BARE = ("F", "R"), ("C",), ("M", "G"), ("T", "X")


def event_lines(events: DataFrame) -> DataFrame:
    """One text line an event: kind, stamp, arrival and the payload, reals with as many digits as tell them apart."""
    kind = F.col("kind")
    fix = F.concat_ws(" ", *(F.element_at("lla", i).cast("string") for i in (1, 2, 3)), F.coalesce("status", F.lit(-1)).cast("string"))
    body = F.when(kind.isin(*REAL), F.col("value").cast("string")).when(kind.isin(*WHOLE), F.col("value").cast("long").cast("string")).when(kind.isin(*FIX), fix)
    return events.select(F.concat_ws(" ", kind, F.col("stamp").cast("string"), F.col("arrival").cast("string"), body).alias("value"))


def read_events(lines: DataFrame) -> DataFrame:
    """Events of text lines (column ``value``); lines that are none are left out."""
    p = F.split(F.trim("value"), r"\s+")
    n, kind = F.size(p), p[0]
    number = lambda i: F.get(p, F.lit(i)).try_cast("double")
    whole = lambda i: F.get(p, F.lit(i)).try_cast("long")
    right = (kind.isin(*REAL, *WHOLE) & (n == 4)) | (kind.isin(*FIX) & (n == 7)) | (kind.isin(*BARE) & (n == 3))
    fix = kind.isin(*FIX)
    out = lines.where(right).select(
        kind.alias("kind"),
        whole(1).alias("stamp"),
        whole(2).alias("arrival"),
        F.when(kind.isin(*REAL, *WHOLE), number(3)).alias("value"),
        F.when(fix, F.array(number(3), number(4), number(5))).alias("lla"),
        F.when(fix, whole(6).cast("int")).alias("status"),
    )
    complete = F.when(fix, F.forall("lla", lambda v: v.isNotNull()) & F.col("status").isNotNull()).when(F.col("kind").isin(*REAL, *WHOLE), F.col("value").isNotNull()).otherwise(True)
    return out.where(F.col("stamp").isNotNull() & F.col("arrival").isNotNull() & complete)


def _fixed(layout: np.dtype):
    types = {"f8": pa.float64(), "i8": pa.int64(), "u1": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if len(content) % layout.itemsize:
                    raise ValueError(f"{path} ends within a record")
                rows = np.frombuffer(content, layout)
                for i in range(0, len(rows), 50_000):
                    part = rows[i : i + 50_000]
                    columns = {"path": pa.array([path] * len(part)), "place": pa.array(np.arange(i, i + len(part)))}
                    for name in layout.names:
                        a = part[name]
                        columns[name] = pa.FixedSizeListArray.from_arrays(pa.array(a.astype("f4").ravel()), a.shape[1]).cast(pa.list_(pa.float32())) if a.ndim > 1 else pa.array(a, types[a.dtype.str[1:]])
                    yield pa.RecordBatch.from_pydict(columns)

    return run


#: Little-endian records: a feature row, and an event of a stream.
FEATURE_RECORD = np.dtype([("t", "<f8"), ("x", "<f4", (26,))])
EVENT_RECORD = np.dtype([("kind", "u1"), ("stamp", "<i8"), ("value", "<f8")])


def read_feature_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_fixed(FEATURE_RECORD), "path string, place long, t double, x array<float>")


def read_event_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_fixed(EVENT_RECORD), "path string, place long, kind int, stamp long, value double")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated rows of exactly the prediction's columns; anything else fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    p = F.split(F.trim("value"), r"\s+")
    n = len(PREDICTION_COLUMNS)
    checked = F.when(F.size(p) == n, p).otherwise(F.raise_error(F.concat(F.lit(f"a prediction has {n} columns: "), "value")))
    return lines.select(checked.alias("p")).select(*(F.col("p")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(PREDICTION.fields)))


def read_route(spark: SparkSession, path: str) -> DataFrame:
    """A route's s, x, y, z; s must be finite and rise strictly."""
    from pyspark.sql import Window

    rows = spark.read.csv(path, schema=ROUTE, header=True, mode="FAILFAST").withColumn("file", F.input_file_name())
    finite = F.forall(F.array("s", "x", "y", "z"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # Lines of one file keep their order in one partition; ids follow it.
    numbered = rows.withColumn("place", F.monotonically_increasing_id())
    before = F.lag("s").over(Window.partitionBy("file").orderBy("place"))
    ok = finite & (before.isNull() | (F.col("s") > before))
    checked = numbered.withColumn("ok", ok)
    return checked.select(F.when(F.col("ok"), F.col("s")).otherwise(F.raise_error(F.lit("a route's s is finite and rises"))).alias("s"), "x", "y", "z", "file")


def write_route(route: DataFrame, path: str) -> None:
    """One CSV file in order of s, with nine decimals; a route is a bounded table."""
    decimals = [F.format_string("%.9f", F.col(c)).alias(c) for c in ("s", "x", "y", "z")]
    route.orderBy("s").select(*decimals).coalesce(1).write.csv(path, header=True)


def read_pathgraph(spark: SparkSession, path: str, yaw: float = 0.0, translation: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """place, x, y, z of a path graph's points, taken back through the output frame's transform."""
    points = spark.read.json(path, multiLine=True).select(F.posexplode("points").alias("place", "p"))
    moved = tuple(F.col(f"p.{c}") - t for c, t in zip("xyz", translation, strict=True))
    return points.select("place", *(v.alias(c) for v, c in zip(geo.rotate(moved, -yaw), "xyz", strict=True)))


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines without NaN: values that are no number become null; an existing report stays."""
    plain = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*plain).write.mode("errorifexists").json(path)
