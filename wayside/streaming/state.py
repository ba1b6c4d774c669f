"""Keyed state for streams: the folds of tables, carried across micro-batches.

Rows of a key are sorted by arrival within each micro-batch, and a fold sees nothing but its
state and the next row, so results do not depend on where batches end (as long as batches
themselves come in arrival order, which a log or a folder of files in order provides).  A
state is a row of typed columns, one for each number that the fold remembers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import LANES, Arrays, Fold, advance_all

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TYPES = {"f": "double", "i": "long", "b": "boolean"}


def state_schema(fold: Fold) -> str:
    """Columns for one run's state; arrays of two are two columns."""
    return ", ".join(f"{k}_{i} {_TYPES[a.dtype.kind]}" for k, a in fold.start(1).items() for i in range(a.size))


def to_row(state: Arrays) -> tuple:
    return tuple(v for a in state.values() for v in a.ravel().tolist())


def from_row(fold: Fold, row: tuple) -> Arrays:
    state, at = fold.start(1), 0
    for a in state.values():
        a[...] = np.array(row[at : at + a.size], a.dtype).reshape(a.shape)
        at += a.size
    return state


def to_bytes(state: Arrays) -> tuple:
    return (zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in state.values()), 1),)


def from_bytes(fold: Fold, row: tuple) -> Arrays:
    state, at, data = fold.start(1), 0, zlib.decompress(row[0])
    for a in state.values():
        a[...] = np.frombuffer(data, a.dtype, a.size, at).reshape(a.shape)
        at += a.nbytes
    return state


def resetting(fold: Fold, clock: str) -> Fold:
    """``fold`` that starts anew at each row whose ``clock`` is before that of the row before it; gives also which start it was (``sub_run``)."""

    def start(n: int) -> Arrays:
        return fold.start(n) | {"_clock": np.full(n, np.iinfo(np.int64).min), "_sub_run": np.zeros(n, np.int64)}

    def step(state: Arrays, x: Arrays) -> Arrays:
        back = x[clock] < state["_clock"]
        if back.any():
            for k, v in fold.start(int(back.sum())).items():
                state[k][back] = v
        state["_clock"][...] = x[clock]
        state["_sub_run"] += back
        return fold.step({k: v for k, v in state.items() if k not in ("_clock", "_sub_run")}, x) | {"sub_run": state["_sub_run"].copy()}

    return Fold(start, step, tuple(dict.fromkeys((*fold.reads, clock))), fold.gives | {"sub_run": "long"}, fold.keep)


#: Pages that the keys of a stream are dealt to: a call a page and micro-batch, however many keys there are.
PAGES = 512


def by_page(stream: DataFrame, key: list[str]):
    """``stream`` in groups of many keys; keys of a group are null in the same columns, so a column's type stands."""
    nulls = sum((F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(key)), F.lit(0))
    return stream.withColumn("_page", F.pmod(F.xxhash64(*key), F.lit(PAGES)) + PAGES * nulls).groupBy("_page")


def lanes(known: pd.DataFrame | None, rows: pd.DataFrame, key: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """The place of each row's key among the keys of its page, and these: those known first, in their order."""
    both = rows[key] if known is None else pd.concat([known, rows[key]])
    place = both.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
    _, first = np.unique(place, return_index=True)
    return place[len(both) - len(rows) :], both.iloc[first].reset_index(drop=True)


def packed(columns: dict[str, pd.Series | np.ndarray]) -> bytes:
    """Columns of one length as Arrow's bytes, NaN kept where numbers come from numpy."""
    table = pa.table({k: pa.Array.from_pandas(v) if isinstance(v, pd.Series) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def numbers(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(n).to_numpy().copy() for n in names]


class KeyedFold(StatefulProcessor):
    """Keys of a page go forward together; their states are one value, a row of typed columns for each."""

    def __init__(self, fold: Fold, key: list[str], order: list[str]) -> None:
        self.fold, self.key, self.order = fold, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "states binary")

    def _load(self) -> tuple[pd.DataFrame | None, Arrays]:
        if not self.page.exists():
            return None, self.fold.start(0)
        held = unpacked(self.page.get()[0])
        n, states = held.num_rows, {}
        for k, a in self.fold.start(0).items():
            width = int(np.prod(a.shape[1:]))
            states[k] = np.stack(numbers(held, [f"{k}_{i}" for i in range(width)]), axis=1).reshape(n, *a.shape[1:]).astype(a.dtype)
        return held.select(self.key).to_pandas(), states

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True).drop(columns="_page", errors="ignore")
        known, states = self._load()
        lane, keys = lanes(known, every, self.key)
        more = self.fold.start(len(keys) - len(next(iter(states.values()))))
        states = {k: np.concatenate([v, more[k]]) for k, v in states.items()}
        every["_lane"] = lane
        every = every.sort_values(["_lane", *self.order], kind="stable")
        here, begin, size = np.unique(every.pop("_lane").to_numpy(), return_index=True, return_counts=True)
        given, after = advance_all(self.fold, {c: every[c].to_numpy() for c in self.fold.reads}, begin, size, {k: v[here] for k, v in states.items()})
        for k, v in after.items():
            states[k][here] = v
        flat = {f"{k}_{i}": np.ascontiguousarray(c) for k, v in states.items() for i, c in enumerate(v.reshape(len(keys), -1).T)}
        self.page.update((packed({**{k: keys[k] for k in self.key}, **flat}),))
        out = every.assign(**{k: v for k, v in given.items() if k != self.fold.keep})
        if self.fold.keep:
            out = out[given[self.fold.keep]]
        if len(out):
            yield out

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: list[str], fold: Fold, order: tuple[str, ...] = ("arrival", "id")) -> DataFrame:
    """``fold`` over each key of a stream, rows in ``order`` within a micro-batch; for states of few numbers (see in_lanes())."""
    return by_page(stream, key).transformWithStateInPandas(KeyedFold(fold, key, list(order)), outputStructType=fold.schema(stream), outputMode="Append", timeMode="None")


class LanesFold(StatefulProcessor):
    """Runs of a bucket go forward together; the state of each is a value of its own, read and written only when it has rows."""

    def __init__(self, fold: Fold, run: str, kind: str, order: list[str]) -> None:
        self.fold, self.run, self.kind, self.order = fold, run, kind, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", f"run {self.kind}", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values([self.run, *self.order], kind="stable").drop(columns="_bucket", errors="ignore")
        runs, begin, size = np.unique(every[self.run].to_numpy(), return_index=True, return_counts=True)
        for first in range(0, len(runs), LANES):  # so many states at once
            few = slice(first, first + LANES)
            own = every.iloc[begin[few][0] : begin[few][-1] + size[few][-1]]
            yield from self._advanced(own, runs[few].tolist(), begin[few] - begin[first], size[few])

    def _advanced(self, rows: pd.DataFrame, runs: list, begin: np.ndarray, size: np.ndarray) -> Iterator[pd.DataFrame]:
        lanes = [from_bytes(self.fold, tuple(self.states.getValue((r,)))) if self.states.containsKey((r,)) else self.fold.start(1) for r in runs]
        before = {k: np.concatenate([s[k] for s in lanes]) for k in lanes[0]}
        given, after = advance_all(self.fold, {c: rows[c].to_numpy() for c in self.fold.reads}, begin, size, before)
        for j, r in enumerate(runs):
            self.states.updateValue((r,), to_bytes({k: v[j : j + 1] for k, v in after.items()}))
        out = rows.assign(**{k: v for k, v in given.items() if k != self.fold.keep})
        if self.fold.keep:
            out = out[given[self.fold.keep]]
        if len(out):
            yield out

    def close(self) -> None:
        pass


def in_lanes(stream: DataFrame, run: str, fold: Fold, order: tuple[str, ...] = ("arrival", "id"), buckets: int = 64) -> DataFrame:
    """keyed() for folds whose steps are many: the runs of a bucket share each step.  A run is never null."""
    dealt = stream.withColumn("_bucket", F.pmod(F.hash(run), F.lit(buckets)))
    processor = LanesFold(fold, run, stream.schema[run].dataType.simpleString(), list(order))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, outputStructType=fold.schema(stream), outputMode="Append", timeMode="None")


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB while a stream is started; the session's own choice comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is available now, appended to Parquet; a restart goes on from the checkpoint."""
    with rocksdb(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
