"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it equals the block size less one modulo
the block size, so boundaries move with the content.  Each chunk leaves six bits of its hash as
one character.  A fingerprint is ``block size:signature:signature at twice the block size``;
block sizes are three times a power of two, chosen so that the signature has 32 to 64
characters where the text allows.  Fingerprints of equal or doubled block size are compared by
edit distance (insertion and deletion one each, a change two).

To meet each document with its successor, the row keys alone (16 bytes each) are range
partitioned first; the smallest key of each range is a bound, and the document that has it is
also sent to the range before it.  Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch, keyed
from .wordhash import CHUNK_BYTES, mix

WINDOW, SHORTEST, FULL = 7, 3, 64
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARS = np.frombuffer(_ALPHABET.encode(), np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from .wordhash import _BYTE_POWERS

    return _BYTE_POWERS.to(n)


def _signature(ends: np.ndarray, sums: np.ndarray, down: np.ndarray, begin: int, end: int, most: int) -> str:
    """Chunks end after ``ends`` and at ``end``; those past ``most`` count as one."""
    cut = ends[: most - 1] + 1
    edges = np.concatenate([[begin], cut, [end]]) if not len(cut) or cut[-1] < end else np.concatenate([[begin], cut])
    h = mix((sums[edges[1:]] - sums[edges[:-1]]) * down[edges[:-1]])
    return _CHARS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[str]:
    """A fingerprint for each text; the empty text has ``3::``."""
    out: list[str] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
            size += len(texts[j])
            j += 1
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
        out += _chunk(data, offsets)
        i = j
    return out


def _chunk(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    # The hash of the seven bytes that end at each place, and how often 2 divides its successor.
    spots, level = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) >= WINDOW:
        rolled = (mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(data) + 1 - WINDOW]) >> np.uint64(33)).astype(np.int64) + 1
        spots = np.flatnonzero(rolled % 3 == 0)
        r = rolled[spots]
        level = np.bitwise_count((r & -r) - 1).astype(np.int64)
        spots += WINDOW - 1
    first = np.searchsorted(spots, offsets[:-1] + WINDOW - 1).tolist()
    last = np.searchsorted(spots, offsets[1:]).tolist()
    out = []
    for begin, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first, last, strict=True):
        if begin == end:
            out.append("3::")
            continue
        own, high, k = spots[a:b], level[a:b], 0
        while SHORTEST * (1 << k) * FULL < end - begin:
            k += 1
        ends = own[high >= k]
        while k and len(ends) + 1 < FULL // 2:
            k -= 1
            ends = own[high >= k]
        out.append(f"{SHORTEST << k}:{_signature(ends, sums, down, begin, end, FULL)}:{_signature(own[high > k], sums, down, begin, end, FULL // 2)}")
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance over both lengths; 0 without a run of characters in common.

    The run guards against chance: four characters, or three or two for short signatures.
    """
    shorter = min(len(a), len(b))
    n = min(shorter, 2 if shorter <= 8 else 3 if shorter <= 24 else 4)
    if not n or not ({a[i : i + n] for i in range(len(a) + 1 - n)} & {b[i : i + n] for i in range(len(b) + 1 - n)}):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; equal fingerprints have 1, incompatible block sizes 0."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2))
    if int(m) == 2 * int(n):
        return _alike(a1, b2)
    if 2 * int(m) == int(n):
        return _alike(a2, b1)
    return 0.0


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _once(f: Callable[[list], list], items: list) -> list:
    """f(items), with repeated items computed once: copies of a document stand side by side."""
    own = list(dict.fromkeys(items))
    found = dict(zip(own, f(own), strict=True))
    return [found[x] for x in items]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; the last row of a range only serves the one before it."""
    rows: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        texts = [r[2] for r in rows]
        prints = _once(fingerprints, [t.encode() for t in texts])
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        changed = [_edited(texts[i], texts[i + 1]).encode() for i in pairs]
        if pairs:
            edited = _once(fingerprints, changed)
            alike = lambda them: np.array(_once(lambda some: [likeness(a, b) for a, b in some], them))
            yield batch(
                doc_id=pa.array([rows[i][3] for i in pairs], pa.int64()),
                n_chars=np.array([len(texts[i]) for i in pairs], np.int64),
                edited_sha256=[hashlib.sha256(x).hexdigest() for x in changed],
                fingerprint=[prints[i] for i in pairs],
                edited_fingerprint=edited,
                near_edited=alike([(prints[i], e) for i, e in zip(pairs, edited, strict=True)]),
                near_next=alike([(prints[i], prints[i + 1]) for i in pairs]),
            )
        del rows[:-1]

    size = 0
    for b in batches:
        for i in range(0, b.num_rows, 128):
            part = b.slice(i, 128)
            texts = part.column("text").to_pylist()
            for p, tail, text, doc_id in zip(part.column("p").to_pylist(), part.column("tail").to_pylist(), texts, part.column("doc_id").to_pylist(), strict=True):
                rows.append((p, tail, text or "", doc_id))
                size += len(text or "")
                if size > CHUNK_BYTES:
                    yield from flush()
                    size = 0
    if len(rows) > 1:
        yield from flush()


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` with its range p; the first document of a range also stands last in the one before."""
    keys = docs.select("ord", "tag").repartitionByRange(ranges, "ord", "tag").select("ord", "tag", F.spark_partition_id().alias("p"))
    heads = sorted({(r.head.ord, r.head.tag) for r in keys.groupBy("p").agg(F.min(F.struct("ord", "tag")).alias("head")).collect()})  # a row for each range
    bounds = np.array(heads, [("ord", "<i8"), ("tag", "<i8")])

    @F.pandas_udf("int")
    def place(ord: pd.Series, tag: pd.Series) -> pd.Series:
        rows = np.empty(len(ord), bounds.dtype)
        rows["ord"], rows["tag"] = ord.to_numpy(), tag.to_numpy()
        return pd.Series(np.maximum(np.searchsorted(bounds, rows, "right") - 1, 0).astype(np.int32))

    placed = docs.withColumn("p", place("ord", "tag"))
    before = docs.sparkSession.createDataFrame([(o, t, (i - 1) % len(heads)) for i, (o, t) in enumerate(heads)], "ord long, tag long, p int")
    copies = docs.where(F.col("ord").isin([o for o, _ in heads])).join(F.broadcast(before), ["ord", "tag"])  # a row for each range
    columns = ("p", "tail", "ord", "tag", "doc_id", "text")
    return placed.withColumn("tail", F.lit(False)).select(*columns).unionByName(copies.dropDuplicates(["ord", "tag", "p"]).withColumn("tail", F.lit(True)).select(*columns))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next are.

    Edited: the last quarter of the code points (rounded down) gives way to the first as many
    (or all) of the next document by doc_id; after the last comes the first.  Null texts are
    empty; rows of one doc_id follow each other by a hash of their texts; a null doc_id is
    last, and rows without an id are dealt to as many ranges as others.  Repeated rows are each
    other's successors.  A table of one document is its own successor; an empty one gives no rows.
    """
    source = keyed(docs, id_col, text_col)
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _ranged(source, ranges).repartition("p").sortWithinPartitions("p", "tail", "ord", "tag").select("p", "tail", "text", "doc_id")
    return arrow_map(ordered, _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
