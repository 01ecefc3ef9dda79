"""Readable and unreadable blocks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import percent


def sector_maps(blocks: DataFrame, file: str, block: str, size: str, bad: str) -> DataFrame:
    """Per file: total_blocks, bad_blocks, good_bytes, bad_bytes, readable percent, from one row per block."""
    n = F.coalesce(F.col(bad), F.lit(False))
    out = blocks.groupBy(file).agg(
        F.count("*").alias("total_blocks"),
        F.count_if(n).alias("bad_blocks"),
        F.sum(F.when(~n, F.col(size)).otherwise(0)).alias("good_bytes"),
        F.sum(F.when(n, F.col(size)).otherwise(0)).alias("bad_bytes"),
    )
    return out.withColumn("readable", percent(F.col("good_bytes"), F.col("good_bytes") + F.col("bad_bytes")))


def heatmap(blocks: DataFrame, file: str, block: str, bad: str, width: int) -> DataFrame:
    """At most ``width`` cells per file, each bad if any of its blocks is; blocks are counted from 0."""
    ends = blocks.groupBy(file).agg((F.max(block) + 1).alias("n"))
    per = F.greatest(F.ceil(F.col("n") / F.lit(width)), F.lit(1))
    return blocks.join(ends, file).groupBy(file, F.floor(F.col(block) / per).cast("int").alias("cell")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))


def bad_report(maps: DataFrame) -> DataFrame:
    """One row over the maps: files scanned, files with bad blocks, bad blocks and bytes."""
    hurt = F.col("bad_blocks") > 0
    return maps.agg(
        F.count("*").alias("files_scanned"),
        F.count_if(hurt).alias("files_with_bad_sectors"),
        F.coalesce(F.sum("bad_blocks"), F.lit(0)).alias("total_bad_blocks"),
        F.coalesce(F.sum(F.when(hurt, F.col("bad_bytes"))), F.lit(0)).alias("total_bad_bytes"),
    )


def zero_filled(blocks: DataFrame, bad: DataFrame, file: str, block: str, content: str) -> DataFrame:
    """The blocks with those listed in ``bad`` replaced by as many zero bytes."""
    marked = blocks.join(bad.select(file, block).distinct().withColumn("__bad", F.lit(True)), [file, block], "left")
    zeros = F.unhex(F.repeat(F.lit("00"), F.octet_length(content)))
    return marked.withColumn(content, F.when(F.col("__bad"), zeros).otherwise(F.col(content))).drop("__bad")


def with_bad(known: DataFrame, found: DataFrame) -> DataFrame:
    """Bad sectors known so far and those found in addition, each once."""
    return known.unionByName(found).distinct()


def replace_bad(known: DataFrame, found: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """Bad sectors with those of ``files`` replaced by what was found; an empty ``found`` clears them."""
    return known.join(files.select(file).distinct(), file, "left_anti").unionByName(found.join(files.select(file).distinct(), file, "left_semi")).distinct()


def report_text(report: DataFrame) -> DataFrame:
    """The report of ``bad_report`` as lines to read: ``text``."""
    return report.select(
        F.format_string(
            "Files scanned: %d\nFiles with bad sectors: %d\nBad blocks: %d\nBad bytes: %d",
            *(F.col(c).cast("long") for c in ("files_scanned", "files_with_bad_sectors", "total_bad_blocks", "total_bad_bytes")),
        ).alias("text")
    )


def write_report(report: DataFrame, path: str, as_json: bool = True) -> None:
    """Write the report of ``bad_report``: one JSON document, or lines to read."""
    out = report.coalesce(1).write.mode("overwrite") if as_json else report_text(report).coalesce(1).write.mode("overwrite")
    out.json(path) if as_json else out.text(path)
