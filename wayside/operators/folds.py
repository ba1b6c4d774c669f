"""Ordered folds: recursions along a run that no window frame expresses, for tables and for streams.

A fold is a start and a step over arrays with one place for each run, so all runs of a batch
go forward together: the first row of each, then the second of each, and so on.  In a table a
partition holds whole runs in order, is read batch by batch, and only the state of the run
that a batch ends in waits for the next one; no run is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]
_TYPES = {"double": np.float64, "int": np.int32, "long": np.int64, "boolean": np.bool_}


@dataclass(frozen=True)
class Fold:
    """start(n): the state of n runs before their first row, one row of each array a run.

    step(state, x): takes the next row of each run (the columns ``reads``), changes the state
    in place and returns the columns ``gives``.  keep: of these, a boolean one that says which
    rows come out; it does not come out itself.
    """

    start: Callable[[int], Arrays]
    step: Callable[[Arrays, Arrays], Arrays]
    reads: tuple[str, ...]
    gives: dict[str, str]
    keep: str | None = None

    def renamed(self, names: dict[str, str]) -> Fold:
        """The same fold with other names for some of what it gives."""
        after = lambda k: names.get(k, k)
        step = lambda state, x: {after(k): v for k, v in self.step(state, x).items()}
        return replace(self, step=step, gives={after(k): v for k, v in self.gives.items()}, keep=after(self.keep))

    def schema(self, rows: DataFrame) -> str:
        """The columns of ``rows`` and what the fold gives."""
        mine = [f"{k} {v}" for k, v in self.gives.items() if k != self.keep]
        return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), *mine])


def advance_all(fold: Fold, x: Arrays, begin: np.ndarray, size: np.ndarray, states: Arrays) -> tuple[Arrays, Arrays]:
    """What the fold gives for rows of several runs, run after run, and the states of all after it.

    begin, size: where each run stands.  states: of all runs before, one row of each array a run.
    """
    order = np.argsort(-size, kind="stable")
    state = {k: v[order] for k, v in states.items()}
    out = {k: np.zeros(int(size.sum()), _TYPES[v]) for k, v in fold.gives.items()}
    longest = np.sort(size)
    for k in range(int(longest[-1])):
        lanes = len(size) - int(np.searchsorted(longest, k, "right"))
        at = begin[order[:lanes]] + k
        given = fold.step({n: a[:lanes] for n, a in state.items()}, {n: a[at] for n, a in x.items()})
        for n, a in out.items():
            a[at] = given[n]
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    return out, {k: state.pop(k)[place] for k in list(state)}  # two copies of one array at most


def advance(fold: Fold, x: Arrays, begin: np.ndarray, size: np.ndarray, carried: Arrays | None = None) -> tuple[Arrays, Arrays]:
    """What the fold gives for rows of several runs, and the last run's state; carried: the state of the first run, if it goes on."""
    states = fold.start(len(size))
    if carried is not None:
        for k, v in carried.items():
            states[k][0] = v[0]
    out, states = advance_all(fold, x, begin, size, states)
    return out, {k: v[-1:].copy() for k, v in states.items()}


def _together(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``held`` rows at least, so that more runs go forward together."""
    waiting, size = [], 0
    for b in batches:
        waiting.append(b)
        size += b.num_rows
        if size >= held:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _stream(fold: Fold, run: str, names: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ends = pc.run_end_encode(b.column(run)).run_ends.to_numpy()
            begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            runs = b.column(run)
            same = last is not None and runs[0] == last
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in fold.reads}
            out, carried = advance(fold, x, begin, np.diff(np.append(begin, b.num_rows)), carried if same else None)
            last = runs[-1]
            made = pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(out[k]) for k in fold.gives if k != fold.keep)], [*names, *(k for k in fold.gives if k != fold.keep)])
            yield made.filter(pa.array(out[fold.keep])) if fold.keep else made

    return go


def along(rows: DataFrame, run: str, order: list[str], fold: Fold, parts: int | None = None) -> DataFrame:
    """``rows`` with what the fold gives, each run in the order of ``order``; what it reads must not be null.

    parts: tasks that runs are dealt to; rows that are so dealt already are not shuffled again.
    """
    sorted_rows = (rows.repartition(parts, run) if parts else rows.repartition(run)).sortWithinPartitions(run, *order)
    return sorted_rows.mapInArrow(_stream(fold, run, rows.columns), fold.schema(rows))


#: Runs that go forward side by side, about: enough to share a step, few enough for a task to hold their states.
LANES = 1024


def _sliced(fold: Fold, run: str, names: list[str], held: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, pool = None, {}, fold.start(0)
        gives = [k for k in fold.gives if k != fold.keep]
        for b in _together((x for x in batches if x.num_rows), held):
            edges = np.flatnonzero(np.diff(b.column("_group").to_numpy()) | np.diff(b.column("_slice").to_numpy())) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                part = b.slice(first, end - first)
                if (own := part.column("_group")[0].as_py()) != group:  # no run of the groups before comes again
                    group, index, pool = own, {}, fold.start(0)
                ends = pc.run_end_encode(part.column(run)).run_ends.to_numpy()
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                runs = part.column(run).take(pa.array(begin)).to_pylist()
                for r in runs:
                    index.setdefault(r, len(index))
                size = len(next(iter(pool.values())))
                if len(index) > size:
                    more = fold.start(len(index) - size)
                    pool = {k: np.concatenate([v, more[k]]) for k, v in pool.items()}
                at = np.array([index[r] for r in runs])
                x = {c: part.column(c).to_numpy(zero_copy_only=False) for c in fold.reads}
                whole = len(at) == len(index) and bool((at == np.arange(len(at))).all())
                out, states = advance_all(fold, x, begin, np.diff(np.append(begin, part.num_rows)), pool if whole else {k: v[at] for k, v in pool.items()})
                if whole:
                    pool = states
                else:
                    for k, v in states.items():
                        pool[k][at] = v
                made = pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(out[k]) for k in gives)], [*names, *gives])
                yield made.filter(pa.array(out[fold.keep])) if fold.keep else made

    return go


def along_slices(rows: DataFrame, run: str, order: list[str], fold: Fold, length: int, held: int) -> DataFrame:
    """along() for folds whose steps are many: runs go forward side by side in groups of about LANES, ``length`` rows of each after another.

    Groups go one after another, so a task holds the states of one group however many runs there are, and
    ``held`` rows or so; long runs share steps too.  Runs are counted first.
    """
    runs = rows.agg(F.approx_count_distinct(run)).first()[0]
    groups = max(1, -(-runs // LANES), min(runs, rows.sparkSession.sparkContext.defaultParallelism))
    place = F.row_number().over(Window.partitionBy("_group", run).orderBy(*order))
    # More tasks than groups, so that few tasks have two of them.
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(run), F.lit(groups))).repartition(2 * groups, "_group")
    sliced = grouped.withColumn("_slice", F.floor((place - 1) / length).cast("long"))
    return sliced.sortWithinPartitions("_group", "_slice", run, *order).mapInArrow(_sliced(fold, run, rows.columns, held), fold.schema(rows))


def by_run(rows: DataFrame, run: str, order: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """For each run what ``make()`` returns for its rows, given batch by batch in the order of ``order``.

    For folds whose memory is a bounded queue instead of a few numbers.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            if not b.num_rows:
                continue
            runs, begin, made = b.column(run), 0, []
            for end in pc.run_end_encode(runs).run_ends.to_pylist():
                if own is None or runs[begin] != last:
                    last, own = runs[begin], make()
                made.append(own(b.slice(begin, end - begin)))
                begin = end
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return rows.repartition(run).sortWithinPartitions(run, *order).mapInArrow(go, schema)
