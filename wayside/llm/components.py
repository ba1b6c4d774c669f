"""Connected components of a table of links, by alternating star contraction.

Each round lets every node point its larger neighbours, then itself and its smaller ones, at
the smallest node it sees; sums before the shuffle and joins do the work, and each round's
links are written to the shared folder, so lineage stays short and nothing reaches the driver
but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node that links (a, b) name.

    Self-links and repeated links change nothing; nodes without links do not appear.
    """
    links = checkpointed(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct())
    seen = None
    while True:
        links = checkpointed(_small(_large(links)).where("a != b").distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
