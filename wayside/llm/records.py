"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard ``part-NNNNN.rec`` is a run of records, each framed as

    length      unsigned 64-bit, little endian
    check       masked CRC-32 of those eight bytes
    payload     ``length`` bytes: ids as unsigned 16-bit (vocabularies up to 65,536) or 32-bit
    check       masked CRC-32 of the payload

A check is masked by a rotation of 15 bits and the constant 0xA282EAD8, so that checks of data
that hold checks stay sound.  ``part-NNNNN.idx`` has what shuffled reads need: the magic and
the id width, then for each record its offset, its doc_id and its number of ids.

Documents are range partitioned and sorted by doc_id before they are encoded, one shard a
partition; texts stream through, and only the index of the shard at hand is held.  A task
writes under a name of its own and renames at the end, so a lost or repeated task leaves no
half shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .tables import arrow_map, batch, keyed
from .tokens import END_ID, encoder, tokenizer_path

MAGIC = b"WSREC1\0"
_MASK = 0xA282EAD8
_SHARD = "shard int, docs long, tokens long, bytes long"
_INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("named", "u1"), ("n_tokens", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes:
    """The next payload from a read(n) function; ValueError if anything is damaged."""
    head = read(12)
    if len(head) != 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = read(n + 4)
    if len(body) != n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("damaged record")
    return body[:n]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _writer(path: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, index, at = task.partitionId(), [], 0
        fs, base = _store(path)
        enc = encoder(tokenizer)
        width = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        own = f"{base}/.part-{shard:05d}.{task.taskAttemptId()}"
        out = None
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids = part.column("doc_id").to_pylist()
                for doc_id, packed in zip(ids, enc.encode(part.column("text").cast(pa.binary()).to_pylist()), strict=True):
                    out = out or fs.open_output_stream(f"{own}.rec")
                    tokens = np.append(np.frombuffer(packed, "<u4"), end_id).astype(width)
                    record = frame(tokens.tobytes())
                    out.write(record)
                    index.append((at, doc_id or 0, doc_id is not None, len(tokens)))
                    at += len(record)
        if out is None:
            return
        out.close()
        rows = np.array(index, _INDEX)
        with fs.open_output_stream(f"{own}.idx") as f:
            f.write(MAGIC + width[2:].encode() + rows.tobytes())
        for kind in ("rec", "idx"):
            fs.move(f"{own}.{kind}", f"{base}/part-{shard:05d}.{kind}")
        yield batch(shard=np.array([shard], np.int32), docs=np.array([len(rows)]), tokens=rows["n_tokens"].sum(keepdims=True).astype(np.int64), bytes=np.array([at]))

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int, int]]:
    """Write ``docs`` in ascending doc_id order; (shard, docs, tokens, bytes) of each shard.

    Null and empty texts are a record of ``end_id`` alone.  Rows of one doc_id stand together,
    a null doc_id last.  An empty table writes no shard.  What returns to the driver is one
    row a shard.
    """
    fs, base = _store(path)
    fs.create_dir(base, recursive=True)
    order = ("ord", "tag")
    rows = keyed(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted(tuple(r) for r in arrow_map(rows, _writer(path, tokenizer_path(tokenizer), end_id), _SHARD).collect())


def read_index(path: str, shard: int) -> tuple[np.ndarray, str]:
    """A shard's index rows and the type of its ids."""
    fs, base = _store(path)
    with fs.open_input_stream(f"{base}/part-{shard:05d}.idx") as f:
        data = f.read()
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index of records")
    return np.frombuffer(data[len(MAGIC) + 1 :], _INDEX), f"<u{data[len(MAGIC) : len(MAGIC) + 1].decode()}"


def read_at(path: str, shard: int, numbers: Iterable[int]) -> Iterator[np.ndarray]:
    """The ids of a shard's records in any order, each found through the index."""
    index, width = read_index(path, shard)
    fs, base = _store(path)
    with fs.open_input_file(f"{base}/part-{shard:05d}.rec") as f:
        for k in numbers:
            f.seek(int(index["offset"][k]))
            yield np.frombuffer(unframe(f.read), width)


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(path)
        for b in batches:
            for shard, start in zip(b.column("shard").to_pylist(), b.column("start").to_pylist(), strict=True):
                index, width = read_index(path, shard)
                with fs.open_input_stream(f"{base}/part-{shard:05d}.rec", buffer_size=1 << 20) as f:
                    for i in range(0, len(index), 1000):
                        part, crc = index[i : i + 1000], []
                        for row in part:
                            ids = np.frombuffer(unframe(f.read), width)
                            if len(ids) != row["n_tokens"]:
                                raise ValueError("index and record disagree")
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        n = part["n_tokens"].astype(np.int64)
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield batch(doc_id=pa.array(part["doc_id"], mask=part["named"] == 0), start=starts, n_tokens=n, ids_crc32=np.array(crc, np.int64))

    return run


def read_records(spark: SparkSession, path: str, shards: list[tuple[int, int, int, int]]) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 of every record, read and verified."""
    rows, start = [], 0
    for shard, _, tokens, _ in sorted(shards):
        rows.append((shard, start))
        start += tokens
    table = spark.createDataFrame(rows, "shard int, start long").repartition(max(1, len(rows)))
    return arrow_map(table, _reader(path), "doc_id long, start long, n_tokens long, ids_crc32 long")

