"""New scores of saved predictions, without a new replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import manifests, texts
from . import aggregates


def rescore(saved: DataFrame, reference: DataFrame, key: list[str], by: list[str], out: str) -> None:
    """Errors of ``prediction`` against ``truth`` by groups, written as a report beside the provenance of both.

    saved: key, by, prediction.  reference: key, truth.  Saved rows without a truth count as not
    scored.  A report that is there already stays, and the call fails.
    """
    both = saved.join(reference.select(*key, "truth"), key, "left")
    missed = both.groupBy(*by).agg(F.count_if(F.col("truth").isNull()).alias("unscored"))
    scores = aggregates.error_metric(both.withColumn("error", F.col("prediction") - F.col("truth")).where("truth is not null"), by)
    texts.write_report(missed.join(scores, by, "left"), f"{out}/report")
    texts.write_report(manifests.provenance({"saved": saved, "reference": reference}), f"{out}/provenance")
