"""Splits and provenance: which runs take part, and whether the data are those that were named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_part(rows: DataFrame, manifest: DataFrame, part: str, run: str = "run_id") -> DataFrame:
    """Rows of the runs that a manifest (run, part, sha256, reference_available) puts in a part."""
    return rows.join(manifest.where(F.col("part") == part).select(run), run, "left_semi")


def strangers(files: DataFrame, manifest: DataFrame, run: str = "run_id") -> DataFrame:
    """Files whose content is not what the manifest says; empty if the data may be used."""
    return files.join(manifest.select(run, "sha256"), [run, "sha256"], "left_anti")


def fingerprint(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A hash of rows that does not depend on their order or partitions, and their number."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    # Sums of two halves of each row's hash: they combine before the shuffle and never gather the rows.
    half = lambda i: F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)"))
    made = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), half(1).alias("a"), half(16).alias("b"))
    return made.select(*(by or []), "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("sha256"))


def provenance(parts: dict[str, DataFrame]) -> DataFrame:
    """name, rows and sha256 of each named table."""
    made = [fingerprint(df).withColumn("name", F.lit(name)) for name, df in parts.items()]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select("name", "rows", "sha256")
