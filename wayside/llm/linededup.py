"""Line dedup: range-partitioned hashes, sorted by document and position, and keep bitmaps.

Lines become rows of (key hash, document, position) without text.  The rows are range
partitioned by all three, so that a line in a third of all documents spreads over many
partitions, sorted, and streamed: the first document of a run of equal hashes keeps the line.
A run may reach back into the partition before; the rows at both edges of each partition (two
runs each, so as many as there are partitions) tell the first document of such runs.  What
comes out is one deflated bitmap per document that loses a line.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import LAST_ID, SPACE, anonymous, arrow_map, batch, keyed, lower_ascii, nameless, row_key, written

_DROPPED, _LEADING, _TRAILING = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h1, h2, ord, tag, pos, n_lines) to rows that are dropped or at an edge.

    _DROPPED: not in the first document of its run.  _LEADING: in the first document of the
    partition's first run, which an earlier partition may have begun.  _TRAILING: the first
    row of the partition's last run.
    """
    run, first, first_own, leading, last = None, None, None, True, None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, tag = (b.column(k).to_numpy() for k in ("h1", "h2", "ord", "tag"))
        own = np.where(doc == LAST_ID, tag, 0)
        new = np.empty(len(h1), bool)
        new[0] = run != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if run is None:
            new[0] = True
        elif new[0]:
            leading = False
        which = np.cumsum(new)
        begins = np.flatnonzero(new)
        firsts = np.concatenate([[0 if first is None else first], doc[begins]])
        owns = np.concatenate([[0 if first_own is None else first_own], own[begins]])
        kind = np.where((doc != firsts[which]) | (own != owns[which]), _DROPPED, -1)
        if leading:
            kind[(kind < 0) & (which <= int(run is None))] = _LEADING
        leading = leading and len(begins) <= int(run is None)
        run, first, first_own = (h1[-1], h2[-1]), firsts[-1], owns[-1]
        if len(begins):
            last = b.slice(int(begins[-1]), 1)
        take = np.flatnonzero(kind >= 0)
        if len(take):
            yield b.take(pa.array(take)).append_column("kind", pa.array(kind[take].astype(np.int8)))
    if last is not None:
        yield last.append_column("kind", pa.array([_TRAILING], pa.int8()))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield batch(ord=b.column("ord"), tag=b.column("tag"), n_lines=b.column("n_lines").cast(pa.int64()), keep=pa.array(maps, pa.binary()))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ord, tag (see tables.keyed), n_lines and keep, for each document that loses a line.

    keep: deflated bitmap with a bit for each line.  A key is a line stripped of white space
    at both ends, with A-Z lowered; keys of fewer than ``min_chars`` code points are kept, and
    of the others only the lines in the smallest doc_id stay.  Null texts are empty texts.
    Rows with one doc_id count as one document, rows without an id by their texts; repeated
    rows have one bitmap, which each of them reads.  An empty table has none.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = keyed(docs, id_col, text_col).select("ord", "tag", lines.alias("lines")).select("ord", "tag", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(SPACE)))
    # Hashed once: the range bounds are drawn from these rows before the rows themselves are shuffled.
    hashed = written(rows.select(key.alias("key"), "ord", "tag", "pos", "n_lines").where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "ord", "tag", "pos", "n_lines"), "lines")
    order = ("h1", "h2", "ord", "tag", "pos")
    schema = "h1 long, h2 long, ord long, tag long, pos int, n_lines int, kind byte"
    # Written once: what the two branches below read must come from one set of range bounds.
    found = written(arrow_map(hashed.repartitionByRange(*order).sortWithinPartitions(*order), _stream, schema), "late-lines")
    doc = F.struct("ord", nameless(F.col("ord"), F.col("tag")).alias("own"))
    edges = found.where(F.col("kind") != _DROPPED).groupBy("h1", "h2").agg(F.min(doc).alias("first"))
    late = found.where(F.col("kind") == _LEADING).join(edges, ["h1", "h2"]).where(doc > F.col("first"))
    gone = found.where(F.col("kind") == _DROPPED).select("ord", "tag", "pos", "n_lines").unionByName(late.select("ord", "tag", "pos", "n_lines"))
    per_doc = gone.groupBy("ord", "tag", "n_lines").agg(F.collect_set("pos").alias("gone"))  # rows that agree in id and text give their lines once
    return arrow_map(per_doc, _bitmaps, "ord long, tag long, n_lines long, keep binary")


def _kept(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(x for x, k in zip(lines, bits.tolist(), strict=True) if k), len(lines), int(len(lines) - bits.sum())


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            rows = [_kept(t, k) for t, k in zip(part.column("text").to_pylist(), part.column("keep").to_pylist(), strict=True)]
            yield batch(doc_id=part.column("doc_id"), ord=part.column("ord"), tag=part.column("tag"), text=pa.array([r[0] for r in rows], pa.string()), n_lines=np.array([r[1] for r in rows], np.int64), n_dropped=np.array([r[2] for r in rows], np.int64))


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord, tag, text (kept lines joined by a line feed), n_lines, n_dropped: a row for each of ``docs``."""
    maps = keep_bitmaps(docs, min_chars, id_col, text_col).drop("n_lines")
    joined = keyed(docs, id_col, text_col).join(maps, ["ord", "tag"], "left").select("doc_id", "ord", "tag", "text", "keep")
    return arrow_map(joined, _apply, "doc_id long, ord long, tag long, text string, n_lines long, n_dropped long")


def _rewrite(text_name: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [t if k is None else _kept(t, k)[0] for t, k in zip(part.column(text_name).to_pylist(), part.column("keep").to_pylist(), strict=True)]
                yield batch(**{n: pa.array(texts, pa.string()) if n == text_name else part.column(n) for n in names})

    return run


def drop_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, the repeated lines gone from the texts; see dedup_lines."""
    maps = keep_bitmaps(docs, min_chars, id_col, text_col).drop("n_lines")
    plain, names, fields = anonymous(docs)
    doc_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    joined = plain.withColumns(row_key(F.col(doc_id), F.col(text))).join(maps, ["ord", "tag"], "left").select(*names, "keep")
    return arrow_map(joined, _rewrite(text, names), fields).toDF(*docs.columns)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], min_chars: int = 10) -> list[tuple]:
    """The digest by plain loops, for tests."""
    import re

    def key(line: str) -> str:
        stripped = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)

    first: dict[str, int] = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
