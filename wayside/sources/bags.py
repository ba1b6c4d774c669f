"""Recorded message files (SQLite with a table of topics and one of messages) as a Spark data source.

A partition is one file, so a corpus of recordings spreads over the cluster file by file;
payloads stay binary until they are decoded.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "run_id string, path string, id long, topic string, type string, arrival long, payload binary"


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.root = path if "://" in path else f"file://{os.path.abspath(path)}"

    def partitions(self) -> list[InputPartition]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=False))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".db3")] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.root)
        run = os.path.basename(os.path.dirname(partition.path))
        # SQLite needs a local file; this copy lives as long as the task.
        with tempfile.NamedTemporaryFile(suffix=".db3") as local:
            with fs.open_input_stream(partition.path) as stream:
                while block := stream.read(1 << 20):
                    local.write(block)
            local.flush()
            with sqlite3.connect(f"file:{local.name}?mode=ro", uri=True) as db:
                rows = db.execute("SELECT m.id, t.name, t.type, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id ORDER BY m.timestamp, m.id")
                for id_, topic, kind, arrival, data in rows:
                    yield run, partition.path, id_, topic, kind, arrival, data


class BagSource(DataSource):
    """spark.read.format("wayside_bag").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "wayside_bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_bags(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BagSource)
    return spark.read.format("wayside_bag").load(path)


class Damaged(ValueError):
    pass


class Cdr:
    """A cursor over a little-endian CDR message; every value is aligned to its own size."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"\x00\x01\x00\x00":
            raise Damaged("encapsulation")
        self.data, self.at = data, 4

    def take(self, kind: str, n: int = 1) -> tuple:
        size = struct.calcsize("<" + kind)
        begin = 4 + -(-(self.at - 4) // size) * size
        self.at = begin + size * n
        if self.at > len(self.data):
            raise Damaged("length")
        return struct.unpack_from(f"<{n}{kind}", self.data, begin)

    def text(self) -> str:
        (n,) = self.take("I")
        raw = self.data[self.at : self.at + n]
        if not 1 <= n <= 10_000 or len(raw) < n or raw[-1]:
            raise Damaged("text")
        self.at += n
        return raw[:-1].decode()


#: What follows the header of each kind of message: struct codes with counts.
LAYOUTS = {"wheel": "1d", "command": "1b", "fix": "1b 1H 12d 1B", "velocity": "6d", "odometry": "85d"}


def decode(data: bytes, alias: str) -> tuple[int, str, str, list[float]]:
    """Header nanoseconds, frame, child frame and values of a message; Damaged if it is not one."""
    c = Cdr(data)
    (sec,), (ns,) = c.take("i"), c.take("I")
    if ns >= 1_000_000_000:
        raise Damaged("nanoseconds")
    frame = c.text()
    child = c.text() if alias == "odometry" else ""
    values = [float(v) for part in LAYOUTS[alias].split() for v in c.take(part[-1], int(part[:-1]))]
    if alias == "fix":  # status and service stand first on the wire and last in the tables
        values = [*values[2:14], *values[0:2], values[14]]
    return sec * 1_000_000_000 + ns, frame, child, values


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for data, alias in zip(b.column("payload").to_pylist(), b.column("alias").to_pylist(), strict=True):
            try:
                out.append((*decode(data or b"", alias), None))
            except (Damaged, UnicodeDecodeError) as e:
                out.append((None, None, None, None, str(e)))
        header, frame, child, values, error = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("run_id"), b.column("alias"), b.column("id"), b.column("arrival"), pa.array(header, pa.int64()), pa.array(frame, pa.string()), pa.array(child, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(error, pa.string())],
            names=["run_id", "alias", "id", "arrival", "header", "frame", "child", "data", "error"],
        )


def decoded(messages: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Messages of known topics as columns; damaged ones keep their row, with null values and an error.

    topics: topic name to one of LAYOUTS.
    """
    known = F.create_map(*(F.lit(x) for pair in topics.items() for x in pair))
    rows = messages.where(F.col("topic").isin(*topics)).withColumn("alias", known[F.col("topic")]).select("run_id", "alias", "id", "arrival", "payload")
    return rows.mapInArrow(_decode, "run_id string, alias string, id long, arrival long, header long, frame string, child string, data array<double>, error string")


def unknown_topics(messages: DataFrame, topics: dict[str, str]) -> DataFrame:
    """The topics that decoded() leaves out, with their numbers of messages."""
    return messages.where(~F.col("topic").isin(*topics)).groupBy("topic", "type").agg(F.count(F.lit(1)).alias("n"))
