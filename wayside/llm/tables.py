"""What the document operators share: their input columns, row keys and Arrow helpers.

A document is a row.  ``doc_id`` need not be unique or non-null: rows are told apart by
(doc_id, a hash of the text), rows that agree in both get the same result each.  A null
doc_id ranks after every other; rows without an id are a document for each different text.
Columns besides the id and the text are never read, so their names cannot clash with an
operator's own.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1

#: White space of the text contracts: blank and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord (doc_id, null last), tag (hash of the text) and text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    key = row_key(doc_id, text)
    return docs.select(doc_id.alias("doc_id"), key["ord"].alias("ord"), key["tag"].alias("tag"), text.alias("text"))


def anonymous(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` with columns c0, c1 .., those names, and their DDL: rows to pass through a map whole."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))


def row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    """ord and tag as in keyed()."""
    return {"ord": F.coalesce(doc_id.cast("long"), F.lit(LAST_ID)), "tag": F.when(doc_id.cast("long").isNull(), F.xxhash64(text.cast("string"))).otherwise(F.hash(text.cast("string")).cast("long"))}


def nameless(ord: Column, tag: Column) -> Column:
    """The tag of a row without an id, which alone tells its document; 0 for others."""
    return F.when(ord == LAST_ID, tag).otherwise(F.lit(0).cast("long"))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which a worker gives back what it no longer uses: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(releasing(f), schema)


def batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='wayside-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that no task is run twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: columns of it can be read alone, and its size is known to joins."""
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
