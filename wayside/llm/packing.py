"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the binary digits of n (with as many
pieces of ``size`` as fit first).  Each piece is a sequence of its own, so none crosses
documents and none is padded.  Sequences of equal length form a bucket, and batches of as many
tokens each are drawn from one bucket, so batches are rectangular without padding.  Nothing is
shuffled: a piece depends on its document alone, and a task deals its pieces to batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch
from .tokens import END_ID, WORDS, Encoder, encoder, forget, tokenizer_path

SIZE = 4096


def pieces(n: int, size: int = SIZE) -> list[int]:
    """Lengths that add up to n: ``size`` as often as it fits, then the rest's binary digits."""
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 2, -1, -1) if n % size >> k & 1]


def _pack(tokenizer: str, end_id: int, size: int, batch_tokens: int, with_ids: bool, words: int = WORDS, keep: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from packed_rows(encoder(tokenizer, words), batches)
        finally:
            if not keep:
                forget(tokenizer)

    def packed_rows(enc: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys((1 << k for k in range(size.bit_length())), 0)  # pieces of this task by length
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows, ids = [], []
                for doc_id, packed in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").cast(pa.binary()).to_pylist()), strict=True):
                    packed += end
                    n, start = len(packed) // 4, 0
                    for length in pieces(n, size):
                        piece = packed[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, held[length] // (batch_tokens // length)))
                        held[length] += 1
                        if with_ids:
                            ids.append(piece)
                        start += length
                doc, *rest = zip(*rows, strict=True)
                columns = dict(zip(("start", "length", "ids_crc32", "doc_tokens", "batch"), (np.array(x, np.int64) for x in rest), strict=True))
                yield batch(doc_id=pa.array(doc, pa.int64()), **columns, **({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    return run


def pack(docs: DataFrame, size: int = SIZE, batch_tokens: int = 1 << 16, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id and (if asked) ids.

    size: a power of two.  Every text is encoded whole and ends with ``end_id``; null and empty
    texts are that id alone.  A row of ``docs`` is a document, whatever its doc_id, so repeated
    rows are packed each; an empty table gives no pieces.  ids are packed little-endian
    unsigned 32-bit.  bucket: the length of a sequence as a power of two.  batch_id: with the
    bucket, names up to ``batch_tokens`` tokens of equally long sequences; each task closes its
    last batch of a bucket where its rows end.  words: see ``Encoder.limit``; fewer take less memory
    and more time, and give the same ids.  keep: whether a worker keeps its tokenizer for the next task.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    if batch_tokens < size:
        raise ValueError("a batch holds a whole sequence at least")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, batch long" + ", ids binary" * with_ids
    cut = arrow_map(source, _pack(tokenizer_path(tokenizer), end_id, size, batch_tokens, with_ids, words, keep), schema)
    own = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("batch")
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int"), "batch_id": own}).drop("batch")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each bucket; a task writes one file for each bucket it has."""
    packed.write.partitionBy("bucket").parquet(path)
