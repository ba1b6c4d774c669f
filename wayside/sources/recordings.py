"""Recordings that grow, as a stream, and a sink that commits by epoch.

A recording is an SQLite file of topics and messages whose ids rise.  The offset of the stream is
the last id read of each file, so a batch is the same rows however often it is planned, and a
file that has grown gives its new rows only.

The sink writes each epoch's rows under a name of their own and commits them with one small
file that names them; an epoch that was committed before is not written again, so rows come out
once although a run is killed anywhere.  Readers see committed epochs, and ``latest`` the last
messages of each topic, as a queue of fixed depth holds them.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import closing, contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .bags import SCHEMA

#: Messages of a topic that a reader who comes late still gets.
DEPTH = 100
#: Tasks of a micro-batch at most, and rows that a task holds.
TASKS, ROWS = 96, 10_000
#: Nanoseconds after which a file's time tells that it has not been written since.
SETTLED = 2_000_000_000
_ARROW = pa.schema([("run_id", pa.string()), ("path", pa.string()), ("id", pa.int64()), ("topic", pa.string()), ("type", pa.string()), ("arrival", pa.int64()), ("payload", pa.binary())])


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


@contextmanager
def _opened(fs: pafs.FileSystem, path: str):
    """A recording for reading: in place where it is a local file, else from a copy that lives as long as this."""
    with tempfile.NamedTemporaryFile(suffix=".db3") as local:
        place = path
        if not isinstance(fs, pafs.LocalFileSystem):
            place = local.name
            with fs.open_input_stream(path) as stream:
                while block := stream.read(1 << 20):
                    local.write(block)
            local.flush()
        db = sqlite3.connect(f"file:{place}?mode=ro", uri=True)
        try:
            yield db
        finally:
            db.close()


@dataclass
class _Spans(InputPartition):
    """Files by their path below the folder, of each the ids after one up to another."""

    files: list[tuple[str, int, int]]


def _name(base: str, path: str) -> str:
    return path.removeprefix(f"{base.rstrip('/')}/")


class _Reader(DataSourceStreamReader):
    """A task reads many files, so tasks and the files of the sink are as many however many recordings there are."""

    def __init__(self, path: str) -> None:
        self.root = path
        self.known: dict[str, tuple[tuple, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The last id of each file; those whose size and time (and those of their log) stand are not opened again."""
        fs, base = _store(self.root)
        found = {f.path: f for f in fs.get_file_info(pafs.FileSelector(base, recursive=True))}
        now = time.time_ns()

        def last(path: str) -> tuple[str, int]:
            parts = [found[p] for p in (path, f"{path}-wal") if p in found]
            stands = [(f.size, f.mtime_ns) for f in parts]
            if path in self.known and self.known[path][0] == stands:
                return _name(base, path), self.known[path][1]
            with _opened(fs, path) as db:
                most = db.execute("SELECT coalesce(max(id), 0) FROM messages").fetchone()[0]
            if all(f.mtime_ns is not None and f.mtime_ns < now - SETTLED for f in parts):
                self.known[path] = stands, most
            return _name(base, path), most

        with ThreadPoolExecutor(8) as pool:
            return dict(pool.map(last, (p for p in found if p.endswith(".db3"))))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Neighbouring files share a task, about as many messages in each."""
        base = _store(self.root)[1]
        begun = {_name(base, path): last for path, last in start.items()}  # whole paths in older checkpoints
        new = [(name, begun.get(name, 0), last) for name, last in sorted((_name(base, p), last) for p, last in end.items()) if last > begun.get(name, 0)]
        total, before, dealt = sum(last - after for _, after, last in new), 0, {}
        for name, after, last in new:
            dealt.setdefault(before * TASKS // total, []).append((name, after, last))
            before += last - after
        return [_Spans(files) for files in dealt.values()]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, base = _store(self.root)
        held: list[tuple] = []
        for name, after, last in partition.files:
            path = f"{base.rstrip('/')}/{name}"
            run = os.path.basename(os.path.dirname(path))
            with _opened(fs, path) as db:
                for row in db.execute("SELECT m.id, t.name, t.type, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id WHERE m.id > ? AND m.id <= ? ORDER BY m.id", (after, last)):
                    held.append((run, path, *row))
                    if len(held) >= ROWS:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class RecordingSource(DataSource):
    """spark.readStream.format("wayside_recordings").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "wayside_recordings"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.root = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _store(self.root)
        fs.create_dir(f"{base}/rows", recursive=True)
        name, out = f"rows/{uuid.uuid4().hex}.parquet", None
        for b in iterator:
            out = out or pq.ParquetWriter(f"{base}/{name}", b.schema, filesystem=fs)
            out.write_batch(b)
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def _marker(self, epoch: int) -> tuple[pafs.FileSystem, str, str]:
        fs, base = _store(self.root)
        fs.create_dir(f"{base}/epochs", recursive=True)
        return fs, base, f"{base}/epochs/{epoch}.json"

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, base, marker = self._marker(batchId)
        names = [m.path for m in messages if m is not None and m.path is not None]
        if fs.get_file_info(marker).type != pafs.FileType.NotFound:
            self._forget(fs, base, names)  # the epoch was committed before the run was killed
            return
        own = f"{base}/epochs/.{batchId}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(json.dumps(names).encode())
        fs.move(own, marker)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, base = _store(self.root)
        self._forget(fs, base, [m.path for m in messages if m is not None and m.path is not None])

    @staticmethod
    def _forget(fs: pafs.FileSystem, base: str, names: list[str]) -> None:
        for n in names:
            fs.delete_file(f"{base}/{n}")


class EpochSink(DataSource):
    """stream.writeStream.format("wayside_epochs").option("path", folder)"""

    @classmethod
    def name(cls) -> str:
        return "wayside_epochs"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(self.options["path"])


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the recordings below a folder, now and as they grow: the columns of bags.read_bags()."""
    spark.dataSource.register(RecordingSource)
    return spark.readStream.format("wayside_recordings").load(path)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is available now, committed epoch by epoch; a restart goes on from the checkpoint."""
    stream.sparkSession.dataSource.register(EpochSink)
    q = stream.writeStream.format("wayside_epochs").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed epochs; files of none are not read."""
    fs, base = _store(path)
    names: list[str] = []
    for f in fs.get_file_info(pafs.FileSelector(f"{base}/epochs", allow_not_found=True)):
        if f.path.endswith(".json"):
            with fs.open_input_stream(f.path) as s:
                names += json.loads(s.read())
    root = path if ":/" in path else f"file://{os.path.abspath(path)}"
    return spark.read.schema(schema).parquet(*(f"{root}/{n}" for n in sorted(names))) if names else spark.createDataFrame([], schema)


def latest(rows: DataFrame, topic: str = "topic", order: tuple[str, ...] = ("arrival", "id"), depth: int = DEPTH) -> DataFrame:
    """The last ``depth`` rows of each topic; tasks let go of the others before they are shuffled."""
    newest = Window.partitionBy(topic).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= depth).drop("_n")


def record(rows: DataFrame, path: str) -> DataFrame:
    """Writes a recording for each run, ``path``/RUN/messages.db3, its topics numbered by name; run_id and n of each.

    rows: run_id (string), topic, type, arrival, payload; ids follow arrival, then topic and payload.
    """

    def write(key: tuple, rows_: pa.Table) -> pa.Table:
        fs, base = _store(path)
        run = key[0].as_py()
        own = rows_.sort_by([("arrival", "ascending"), ("topic", "ascending"), ("payload", "ascending")])
        topics = sorted(set(zip(own.column("topic").to_pylist(), own.column("type").to_pylist(), strict=True)))
        number = {t: k + 1 for k, (t, _) in enumerate(topics)}
        messages = zip(*(own.column(c).to_pylist() for c in ("topic", "arrival", "payload")), strict=True)
        with closing(sqlite3.connect(":memory:")) as db:
            db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
            db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
            db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(k + 1, *t) for k, t in enumerate(topics)])
            db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", ((k + 1, number[t], a, p) for k, (t, a, p) in enumerate(messages)))
            db.commit()
            whole = db.serialize()
        fs.create_dir(f"{base}/{run}", recursive=True)
        unfinished = f"{base}/{run}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(unfinished) as out:
            out.write(whole)
        fs.move(unfinished, f"{base}/{run}/messages.db3")
        return pa.table({"run_id": [run], "n": pa.array([own.num_rows], pa.int64())})

    return rows.select("run_id", "topic", "type", "arrival", "payload").groupBy("run_id").applyInArrow(write, "run_id string, n long")
