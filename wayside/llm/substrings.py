"""Substring dedup by level-wise doubling.

Lengths double from ``first`` up to the full window (25 and 50 for a window of 50).  The first
level picks, in each full window, the shortest-length window of smallest hash (the same words
pick the same one), and only picks that stand in two rows or more go on.  Each further level
extends what is left to twice the length, around the pick but within the full window, and
again only windows that repeat go on, until the full length is reached or no candidates
survive.  A full window that repeats repeats at every length below, so none is missed.

A pick whose whole surroundings (all full windows around it, taken together) also stand in a
smaller document is settled at the first level: those full windows are equal word for word and
need not be listed one by one.

Repeats are told by 64 bits where they only decide what goes on, and by 128 where words are
removed.  All comparisons are counts or least documents by hash, combined before the shuffle
and joined back to the rows; joins leave hot hashes for Spark to split.  Texts cross one
shuffle, which the joins that need them share.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import LAST_ID, arrow_map, batch, keyed, written
from .wordhash import NON_SPACE, Words, chunks, least_at, mix


def levels(window: int, first: int) -> list[int]:
    """Lengths that end in ``window``, each half of the next (rounded up); only the first may be below ``first``."""
    out = [window, -(-window // 2)]
    while out[-1] > 1 and -(-out[-1] // 2) >= first:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def _lists(keys: list[np.ndarray], at: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
    """Equal key tuples once each, with their positions as packed 32-bit integers."""
    order = np.lexsort(keys[::-1])
    keys, at = [k[order] for k in keys], at[order]
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    begin = np.flatnonzero(new)
    offsets = pa.py_buffer((4 * np.append(begin, len(at))).astype(np.int32))
    return [k[begin] for k in keys], pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(at.astype("<i4"))])


def _positions(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(b"".join(packed.as_py() or ()), "<i4").astype(np.int64)


def _places(words: Words, window: int, lengths: list[int]) -> np.ndarray:
    """For each full window, where its window of the last of ``lengths`` stands."""
    at = least_at(words.grams(lengths[0]), window - lengths[0] + 1)
    starts = np.arange(len(at))
    for short, long in pairwise(lengths):
        at = starts + np.clip(at - starts - (long - short) // 2, 0, window - long)
    return at


def _first_level(short: int, window: int):
    reach = window - short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            orders, tags = b.column("ord").to_numpy(), b.column("tag").to_numpy()
            for i, _, words in chunks(b.column("text"), NON_SPACE):
                at = np.unique(_places(words, window, [short])[words.whole(window)])
                if not len(at):
                    continue
                doc = words.doc[at]
                lo, hi = np.maximum(at - reach, words.first[doc]), np.minimum(at + window, words.first[doc + 1])
                around = [(words.between(lo, hi, k) + mix((at - lo).astype(np.uint64))).view(np.int64) for k in (0, 1)]
                (doc, h, c1, c2), pos = _lists([doc, words.grams(short)[at].view(np.int64), *around], at - words.first[doc])
                yield batch(h=h, c1=c1, c2=c2, ord=orders[i + doc], tag=tags[i + doc], pos=pos)

    return run


def _next_level(window: int, lengths: list[int]):
    """Windows of the last of ``lengths`` around positions of the last but one that are still alive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            orders, tags, alive = b.column("ord").to_numpy(), b.column("tag").to_numpy(), b.column("alive")
            for i, j, words in chunks(b.column("text"), NON_SPACE):
                marked = np.zeros(len(words) + 1, bool)
                for k in range(i, j):
                    marked[words.first[k - i] + _positions(alive[k])] = True
                live = words.whole(window)
                live = live & marked[_places(words, window, lengths[:-1])] if len(live) else live
                at = np.unique(_places(words, window, lengths)[live])
                if not len(at):
                    continue
                doc = words.doc[at]
                hashes = [words.grams(lengths[-1], k)[at].view(np.int64) for k in (0, 1)]
                (doc, h, h2), pos = _lists([doc, *hashes], at - words.first[doc])
                yield batch(h=h, h2=h2, ord=orders[i + doc], tag=tags[i + doc], pos=pos)

    return run


def _remove(reach: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = (b.column("text")[k].as_py() or "").encode().split()
                n, n_removed = len(words), 0
                pick, full = _positions(b.column("picks")[k]), _positions(b.column("full")[k])
                if len(pick) or len(full):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.concatenate([np.maximum(pick - reach, 0), full]), 1)
                    np.add.at(edge, np.concatenate([np.minimum(pick + window, n), full + window]), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed = int(gone.sum())
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                yield batch(doc_id=b.column("doc_id").slice(k, 1), ord=b.column("ord").slice(k, 1), tag=b.column("tag").slice(k, 1), text=pa.array([b" ".join(words)], pa.binary()).cast(pa.string()), n_words=np.array([n]), n_removed=np.array([n_removed]))

    return run


def _merged(f):
    """Small batches of ``f`` joined to larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in f(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20 or len(held) >= 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose hash h others have too; a document of several equal rows may keep its own, which costs time but no words."""
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return rows.join(often, "h").drop("h")


def remove_repeats(docs: DataFrame, window: int = 50, first: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the words of windows that a document of smaller id also holds.

    Returns doc_id, ord, tag, text (kept words joined by a blank), n_words, n_removed, a row
    for each of ``docs``.  Words are runs of non-white-space; null and empty texts have none,
    texts of fewer than ``window`` words lose none, rows of equal doc_id do not compare; rows
    without an id do, unless their texts are equal.  Repeated rows lose the same words each.
    An empty table gives an empty one.  window: two words at least; first: about the shortest
    length compared.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    lengths = levels(window, first)
    own = F.when(F.col("ord") == LAST_ID, F.col("tag"))  # which tells rows without an id apart
    least = (F.min("ord").alias("least"), F.min(own).alias("least_own"))
    earlier = F.coalesce((F.col("least") < F.col("ord")) | ((F.col("least") == LAST_ID) & (F.col("least_own") < F.col("tag"))), F.lit(False))
    source = keyed(docs, id_col, text_col)
    picks = arrow_map(source, _merged(_first_level(lengths[0], window)), "h long, c1 long, c2 long, ord long, tag long, pos binary")
    repeated = written(_repeated(picks), "picks")
    context = repeated.groupBy("c1", "c2").agg(*least)
    judged = written(repeated.join(context, ["c1", "c2"]).select("ord", "tag", "pos", earlier.alias("settled")), "judged")
    covered = judged.where("settled").select("ord", "tag", "pos", "settled")
    survivors = judged.where(~F.col("settled")).select("ord", "tag", "pos")
    for k in range(1, len(lengths)):
        if survivors.isEmpty():
            break
        # Sets, as rows that agree in id and text bring the same lists.
        alive = survivors.groupBy("ord", "tag").agg(F.collect_set("pos").alias("alive"))
        # doc_id is here only so that all joins with the texts read one and the same shuffle.
        joined = source.join(alive, ["ord", "tag"]).select("doc_id", "ord", "tag", "text", "alive")
        longer = arrow_map(joined, _merged(_next_level(window, lengths[: k + 1])), "h long, h2 long, ord long, tag long, pos binary")
        if lengths[k] < window:
            survivors = written(_repeated(longer).select("ord", "tag", "pos"), "survivors")
            continue
        smallest = longer.groupBy("h", "h2").agg(*least, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        full = longer.join(smallest, ["h", "h2"]).where(earlier).select("ord", "tag", "pos", F.lit(False).alias("settled"))
        covered = covered.unionByName(full)
    spans = covered.groupBy("ord", "tag").agg(F.collect_set(F.when(F.col("settled"), F.col("pos"))).alias("picks"), F.collect_set(F.when(~F.col("settled"), F.col("pos"))).alias("full"))
    joined = source.join(spans, ["ord", "tag"], "left").select("doc_id", "ord", "tag", "text", "picks", "full")
    return arrow_map(joined, _merged(_remove(window - lengths[0], window)), "doc_id long, ord long, tag long, text string, n_words long, n_removed long")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = 50) -> list[tuple]:
    """The digest by plain loops, for tests."""
    import re

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    least: dict[tuple, int] = defaultdict(lambda: 1 << 62)
    for d, w in split.items():
        for i in range(len(w) + 1 - window):
            least[tuple(w[i : i + window])] = min(least[tuple(w[i : i + window])], d)
    out = []
    for d, w in split.items():
        gone = {j for i in range(len(w) + 1 - window) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
