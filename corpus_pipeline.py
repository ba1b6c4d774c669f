"""A corpus pipeline over ``documents``: each stage works on all its predecessor kept.

Every stage's rows are written as Parquet to the shared folder and read again by the next, so
a lost executor costs tasks of one stage at most.  All stages but the last return the columns
of ``documents``, under whatever names further ones have; the last returns the pieces of packed
sequences.  Rows without an id are documents too and come after all others; repeated rows are
copies, of which the third stage keeps one.  Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm import decontaminate, langid, linededup, packing, simhash, tables

#: Near copies: 5-word shingles, of which 0.8 are common.  Of 128 bits of fingerprint such texts differ in 19, give or take 4.
SHINGLE, LEAST, WORDS, RADIUS, MINIMA = 5, 0.8, 2, 32, 6
#: Words whose ids a worker keeps while it packs.  Workers stay for what follows, so what they keep adds to what that needs: they forget them after a task.
KEPT = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null, without a letter, or with a prediction scored below ``langid.LEAST_SCORE``.

    Where no row has a language to learn from, every text with a letter stays.
    """
    return langid.keep_known(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of ten characters or more that an earlier document holds; n_chars counts what is left, which may be nothing."""
    return linededup.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near copies; texts without words are copies of each other."""
    return simhash.keep_first(docs, simhash.groups(docs, SHINGLE, RADIUS, WORDS, repeats=False, minima=MINIMA, least=LEAST))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; an empty benchmark drops none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; an empty text is its end id alone."""
    return packing.pack(docs, words=KEPT, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("decontaminate", benchmark_leaks),
    ("packing", sequences),
]

#: Hashing, learned languages and token ids are beyond SQL; tests hold run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    folder = tables.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
