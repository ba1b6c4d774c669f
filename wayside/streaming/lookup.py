"""As-of lookups in a stream: each question is answered by the newest sample that came before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import by_page, lanes, numbers, packed, unpacked

_NEVER = int(np.iinfo(np.int64).min)
#: Samples that go to the state in one message, and samples that are over but may stay beside as many that wait.
_PART, _SPARE = 10_000, 64


def _rising(stamps: np.ndarray, lane: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which stamps are above all of their lane before them and above its ``last``; rows lie lane by lane."""
    most = pd.Series(stamps).groupby(lane).cummax()
    before = most.groupby(lane).shift(1, fill_value=_NEVER).to_numpy()
    return stamps > np.maximum(before, last[lane])


class Lookup(StatefulProcessor):
    """All samples of each key of a page (see state.by_page) that a later question may ask for wait, those from its future among them.

    Samples before the answer to a key's last question go, as questions and samples both rise; so do,
    with ``most``, all but the newest ``most`` of a key.  Samples are a list of the state to which new ones are
    added; it is read when a question comes, and written anew when most of it is over.
    """

    def __init__(self, key: list[str], most_age: int, most: int | None) -> None:
        self.key, self.most_age, self.most = key, most_age, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "marks binary")
        self.slots = handle.getListState("slots", "lane long, number long, stamp long, value double")

    def _held(self) -> pd.DataFrame:
        """The samples in the list, those that are over among them."""
        rows = list(self.slots.get()) if self.slots.exists() else []
        lane, number, stamp, value = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"lane": np.array(lane, np.int64), "number": np.array(number, np.int64), "stamp": np.array(stamp, np.int64), "value": np.array(value, float)})

    def _add(self, samples: pd.DataFrame) -> None:
        for k in range(0, len(samples), _PART):
            self.slots.appendList(list(zip(*(samples[c].iloc[k : k + _PART].tolist() for c in ("lane", "number", "stamp", "value")), strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        known = None
        first, count, newest, asked = (np.zeros(0, np.int64) for _ in range(4))
        if self.page.exists():
            marks = unpacked(self.page.get()[0])
            known, (first, count, newest, asked) = marks.select(self.key).to_pandas(), numbers(marks, ["_first", "_count", "_newest", "_asked"])
        lane, keys = lanes(known, every, self.key)
        grown = lambda a, v: np.concatenate([a, np.full(len(keys) - len(a), v, np.int64)])
        first, count, newest, asked = grown(first, 0), grown(count, 0), grown(newest, _NEVER), grown(asked, _NEVER)
        every = every.assign(_lane=lane).sort_values(["_lane", "arrival", "id"], kind="stable").reset_index(drop=True)
        ask = every["ask"].to_numpy(bool)
        new, questions = every[~ask], every[ask]
        new = new[_rising(new["stamp"].to_numpy(np.int64), new["_lane"].to_numpy(), newest)]
        questions = questions[_rising(questions["stamp"].to_numpy(np.int64), questions["_lane"].to_numpy(), asked)]
        mine = new["_lane"].to_numpy()
        rank = new.groupby("_lane").cumcount().to_numpy(np.int64)
        added = pd.DataFrame({"lane": mine, "number": count[mine] + rank, "stamp": new["stamp"].to_numpy(np.int64), "value": new["value"].to_numpy(float)})
        reads = len(questions) > 0 or self.most is not None
        old = self._held() if reads else added[:0]
        kept = first if self.most is None else np.maximum(first, count - self.most)
        held = pd.concat([old[old["number"].to_numpy() >= kept[old["lane"].to_numpy()]], added], ignore_index=True).sort_values(["lane", "number"], kind="stable")
        at_lane, stamps, values, number = (held[c].to_numpy() for c in ("lane", "stamp", "value", "number"))
        total = count + np.bincount(mine, minlength=len(keys))
        first = kept.copy()
        if len(questions):
            q, at = questions["_lane"].to_numpy(), questions["stamp"].to_numpy(np.int64)
            # What had come before a question, with ``most`` the newest of that, of these the last not after it.
            came = count[q] + np.searchsorted(new.index.to_numpy(), questions.index.to_numpy()) - np.searchsorted(mine, q)
            _, order = np.unique(np.concatenate([stamps, at]), return_inverse=True)
            wide = len(order) + 1
            until = np.searchsorted(at_lane * wide + order[: len(stamps)], q * wide + order[len(stamps) :], "right")
            begin = np.searchsorted(at_lane, q)
            low = number[np.minimum(begin, len(number) - 1)] if len(number) else np.zeros(len(q), np.int64)
            hit = np.minimum(np.where(until > begin, low + until - begin, first[q]), came) - 1
            missed = hit < (first[q] if self.most is None else np.maximum(first[q], came - self.most))
            place = np.minimum(np.maximum(begin + hit - low, begin), max(len(number) - 1, 0))
            found_at, found = (stamps[place], values[place]) if len(number) else (np.zeros(len(q), np.int64), np.zeros(len(q)))
            missed |= ~missed & (at - found_at > self.most_age)
            last = np.diff(q, append=len(keys)) != 0
            first[q[last]], asked[q[last]] = np.maximum(first[q[last]], hit[last]), at[last]
            told = keys.iloc[q].reset_index(drop=True)
            yield told.assign(id=questions["id"].to_numpy(), seen=pd.arrays.IntegerArray(np.where(missed, 0, found_at), missed), value=pd.arrays.FloatingArray(np.where(missed, 0.0, found), missed.copy()))
        np.maximum.at(newest, mine, new["stamp"].to_numpy(np.int64))
        self.page.update((packed({**{k: keys[k] for k in self.key}, "_first": first, "_count": total, "_newest": newest, "_asked": asked}),))
        waits = number >= (first if self.most is None else np.maximum(first, total - self.most))[at_lane]
        over = len(old) + len(added) - int(waits.sum())
        if reads and over > (_SPARE + waits.sum() if self.most is None else 0):
            self.slots.clear()
            self._add(held[waits])
        else:
            self._add(added)

    def close(self) -> None:
        pass


def lookup(stream: DataFrame, key: list[str], most_age: int, ahead: int, most: int | None = None) -> DataFrame:
    """key, id, seen, value: for each question the newest sample not after it, unless older than ``most_age``.

    stream: key, id, ask, stamp, arrival, value (null in no sample), in order of arrival.  Rows
    stamped more than ``ahead`` later than they arrive are refused, as are those that do not
    rise; a sample from a question's future waits for a later one.  most: of more samples of a key than
    that, the oldest go; without it all wait that a question may still ask for, and a key that never asks keeps all.
    """
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in key)
    usable = stream.where(F.col("stamp") <= F.col("arrival") + ahead).select(*key, "id", "ask", "stamp", "arrival", "value")
    return by_page(usable, key).transformWithStateInPandas(Lookup(key, most_age, most), outputStructType=f"{kinds}, id long, seen long, value double", outputMode="Append", timeMode="None")
