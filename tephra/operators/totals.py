"""Totals of scans, exports and pipelines, each one row of aggregates that start before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts


def scan_totals(files: DataFrame) -> DataFrame:
    """Files, bytes, and files of which the size couldn't be read."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("size").isNull()).alias("unread"))


def export_totals(entries: DataFrame, manifest: str, at: str = "exported_at") -> DataFrame:
    """Per manifest: exported and failed entries, bytes, duration and whole bytes a second."""
    span = F.floor((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / F.lit(1000))
    out = entries.groupBy(manifest).agg(
        F.count_if(F.coalesce("verified", F.lit(False))).alias("exported"),
        F.count_if(~F.coalesce("verified", F.lit(False))).alias("failed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(span, F.lit(0)).alias("duration_ms"),
    )
    return out.withColumn("bytes_per_second", texts.throughput(F.col("bytes"), F.col("duration_ms")))


def pipeline_summary(**stages: DataFrame) -> DataFrame:
    """One row per stage of a pipeline, in the order given: number, stage, rows."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("number"), F.lit(name).alias("stage"), "rows") for i, (name, df) in enumerate(stages.items(), 1)]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out
