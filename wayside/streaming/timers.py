"""Event-time timers: what must come out although no further row does.

Times are microseconds in tables and milliseconds in timers; a timer fires at the first
millisecond that is not before its time, once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import by_page, lanes, numbers, packed, unpacked


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class _Timed(StatefulProcessor):
    """The keys of a page (see state.by_page), their rows in order of time, and one timer for what is due first of all."""

    def __init__(self, key: list[str], time: str, order: list[str]) -> None:
        self.key, self.time, self.order = key, time, [time, *order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "keys binary")

    def _load(self, names: list[str]) -> tuple[pd.DataFrame | None, list[np.ndarray]]:
        """The keys of the page and of each key the columns ``names``."""
        if not self.page.exists():
            return None, [np.zeros(0, np.int64) for _ in names]
        held = unpacked(self.page.get()[0])
        return held.select(self.key).to_pandas(), numbers(held, names)

    def _save(self, keys: pd.DataFrame, **columns: np.ndarray) -> None:
        self.page.update((packed({**{k: keys[k] for k in self.key}, **columns}),))

    def _rows(self, rows: Iterator[pd.DataFrame], known: pd.DataFrame | None) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
        """Rows key by key in order, the place of each one's key, and the keys."""
        every = pd.concat(list(rows), ignore_index=True)
        lane, keys = lanes(known, every, self.key)
        every = every.assign(_lane=lane).sort_values(["_lane", *self.order], kind="stable")
        return every, every["_lane"].to_numpy(), keys

    def _arm(self, times: np.ndarray) -> None:
        wanted = _millis(int(times.min())) if len(times) else None
        for t in list(self.handle.listTimers()):
            t = t[0] if isinstance(t, tuple) else t
            if t == wanted:
                wanted = None
            else:
                self.handle.deleteTimer(t)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def _out(self, keys: pd.DataFrame, lane: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
        return keys.iloc[lane].reset_index(drop=True).assign(**columns)

    def close(self) -> None:
        pass


class FallbackTicks(_Timed):
    """Ticks where a key falls silent: ``quiet`` after its last row, then every ``step`` until the next one."""

    def __init__(self, key: list[str], time: str, quiet: int, step: int) -> None:
        super().__init__(key, time, [])
        self.quiet, self.step = quiet, step

    def _ticks(self, due: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ticks there are from each ``due`` on before ``end``, and all of them."""
        n = np.maximum(-((due - end) // self.step), 0)
        return n, np.repeat(due, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * self.step

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, (held,) = self._load(["due"])
        every, lane, keys = self._rows(rows, known)
        times = every[self.time].to_numpy(np.int64)
        first = np.diff(lane, prepend=-1) != 0
        due = np.zeros(len(keys), np.int64)
        due[lane[first]] = times[first]
        due[: len(held)] = held
        n, ticks = self._ticks(np.where(first, due[lane], np.roll(times, 1) + self.quiet), times)
        last = np.diff(lane, append=len(keys)) != 0
        due[lane[last]] = times[last] + self.quiet
        self._save(keys, due=due)
        self._arm(due)
        if len(ticks):
            yield self._out(keys, np.repeat(lane, n), tick=ticks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, (due,) = self._load(["due"])
        n, ticks = self._ticks(due, np.full(len(due), timerValues.getCurrentWatermarkInMs() * 1000 + 1))
        due = due + n * self.step
        self._save(keys, due=due)
        self.handle.registerTimer(_millis(int(due.min())))
        if len(ticks):
            yield self._out(keys, np.repeat(np.arange(len(keys)), n), tick=ticks)


class OpeningWindow(_Timed):
    """The first ``length`` of a key, summed up once it is over, by a later row or by time alone.

    Every value of a window waits until it is over, in a list of the state to which a micro-batch adds its part.
    """

    def __init__(self, key: list[str], time: str, value: str, length: int) -> None:
        super().__init__(key, time, ["id"])
        self.value, self.length = value, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getListState("parts", "part binary")

    def _add(self, lane: np.ndarray, value: np.ndarray) -> None:
        if len(lane):
            self.parts.appendValue((packed({"lane": lane, "value": value}),))

    def _close(self, over: np.ndarray, keys: pd.DataFrame, end: np.ndarray, n: np.ndarray, closed: np.ndarray) -> Iterator[pd.DataFrame]:
        """Those that are ``over`` come out and need no values any more."""
        closed |= over
        self._save(keys, end=end, n=n, closed=closed)
        if over.any():
            values = pa.concat_tables([unpacked(p[0]) for p in self.parts.get()]).to_pandas()
            mine = over[values["lane"].to_numpy()]
            middle = values[mine].groupby("lane")["value"].median()
            self.parts.clear()
            self._add(values["lane"].to_numpy()[~mine], values["value"].to_numpy()[~mine])
            lane = np.flatnonzero(over)
            yield self._out(keys, lane, ends=end[lane], n=n[lane], middle=middle.loc[lane].to_numpy())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, (end, n, closed) = self._load(["end", "n", "closed"])
        every, lane, keys = self._rows(rows, known)
        times, new = every[self.time].to_numpy(np.int64), len(keys) - len(end)
        first = np.diff(lane, prepend=-1) != 0
        begin = np.zeros(len(keys), np.int64)
        begin[lane[first]] = times[first]
        end, n, closed = np.concatenate([end, begin[len(end) :] + self.length]), np.concatenate([n, np.zeros(new, np.int64)]), np.concatenate([closed, np.zeros(new, bool)]).astype(bool)
        takes = ~closed[lane]
        inside = takes & (times <= end[lane])
        n += np.bincount(lane[inside], minlength=len(keys))
        self._add(lane[inside], every[self.value].to_numpy(float)[inside])
        over = np.zeros(len(keys), bool)
        over[lane[takes & ~inside]] = True
        yield from self._close(over, keys, end, n, closed)
        self._arm(end[~closed] + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, (end, n, closed) = self._load(["end", "n", "closed"])
        closed = closed.astype(bool)
        mark = timerValues.getCurrentWatermarkInMs()
        over = ~closed & (-((-end - 1) // 1000) <= mark)
        yield from self._close(over, keys, end, n, closed)
        if not closed.all():
            self.handle.registerTimer(_millis(int(end[~closed].min()) + 1))


def _kinds(stream: DataFrame, key: list[str]) -> str:
    return ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in key)


def _timed(stream: DataFrame, key: list[str], time: str, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    marked = stream.withColumn("_time", F.timestamp_micros(time)).withWatermark("_time", delay)
    return by_page(marked, key).transformWithStateInPandas(processor, outputStructType=f"{_kinds(stream, key)}, {schema}", outputMode="Append", timeMode="EventTime")


def fallback_ticks(stream: DataFrame, key: list[str], time: str, quiet: int, step: int, delay: str) -> DataFrame:
    """key and tick: see FallbackTicks.  Rows come in order of ``time`` but for ``delay``; after a key's last row its ticks go on to the watermark."""
    return _timed(stream, key, time, delay, FallbackTicks(key, time, quiet, step), "tick long")


def opening_window(stream: DataFrame, key: list[str], time: str, value: str, length: int, delay: str) -> DataFrame:
    """key, ends, n and middle (the median) of each key's first window; a key comes out once and never again."""
    return _timed(stream.dropna(subset=[value]), key, time, delay, OpeningWindow(key, time, value, length), "ends long, n long, middle double")
