"""Export manifests: their root hash, their totals, and what a destination has become."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..runtime import parallelism


def root_hashes(entries: DataFrame, manifest: str, path: str, digest: str) -> DataFrame:
    """``manifest``, root_hash: SHA-256 over the digests in order of path, whatever order the rows come in.

    The rows of a manifest are sorted by Spark, which spills, and streamed through one digest: memory stays
    that of a batch however large the manifest. Equal paths go by digest; NULL digests add nothing.
    """
    rows = entries.select(F.col(manifest).alias("m"), F.col(path).alias("p"), F.coalesce(digest, F.lit("")).alias("h"))
    kind = dict(rows.dtypes)["m"]
    ordered = rows.repartition(parallelism(entries.sparkSession), "m").sortWithinPartitions("m", "p", "h")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            keys, hashes = batch.column("m"), batch.column("h").to_pylist()
            done = []
            for k, h in zip(keys.to_pylist(), hashes):
                if state is None or k != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = k, hashlib.sha256()
                state.update(h.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], keys.type), pa.array([d[1] for d in done])], names=["m", "root_hash"])
            last = keys.type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], last), pa.array([state.hexdigest()])], names=["m", "root_hash"])

    return ordered.mapInArrow(fold, f"m {kind}, root_hash string").withColumnRenamed("m", manifest)


def totals(entries: DataFrame, manifest: str) -> DataFrame:
    """Files, bytes and verified files of each manifest."""
    return entries.groupBy(manifest).agg(F.count("*").alias("total_files"), F.sum(F.coalesce("size", F.lit(0))).alias("total_bytes"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_files"))


def by_extension(entries: DataFrame, manifest: str, path: str) -> DataFrame:
    """Files and bytes of each manifest by upper-case extension, UNKNOWN where there is none."""
    ext = F.upper(names.extension(F.col(path)))
    return entries.groupBy(manifest, F.when(ext == "", "UNKNOWN").otherwise(ext).alias("type")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def verified(entries: DataFrame, found: DataFrame, keys: list[str], size: str, digest: str) -> DataFrame:
    """``keys``, status of every entry: Missing, SizeChanged, HashMismatch or Ok, the first that holds."""
    there = found.select(*keys, F.col(size).alias("__size"), F.col(digest).alias("__digest"), F.lit(True).alias("__there"))
    met = entries.select(*keys, size, digest).join(there, keys, "left")
    status = (
        F.when(F.col("__there").isNull(), "Missing")
        .when(~F.col(size).eqNullSafe(F.col("__size")), "SizeChanged")
        .when(~F.col(digest).eqNullSafe(F.col("__digest")), "HashMismatch")
        .otherwise("Ok")
    )
    return met.select(*keys, status.alias("status"))


def verify_counts(status: DataFrame, manifest: str) -> DataFrame:
    """Verified, failed and missing entries of each manifest, and whether it is clean."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    out = status.groupBy(manifest).agg(F.count("*").alias("total"), n(s == "Ok").alias("verified"), n(s.isin("SizeChanged", "HashMismatch")).alias("failed"), n(s == "Missing").alias("missing"))
    return out.withColumn("clean", (F.col("failed") == 0) & (F.col("missing") == 0))


def destination(path: Column, root: str, flatten: bool = False) -> Column:
    """Where a file is exported to: under ``root`` without its root component, or by its name alone."""
    rest = names.file_name(path) if flatten else F.regexp_replace(path, r"^(?:[A-Za-z]:)?[/\\]+", "")
    return F.concat(F.lit(root.rstrip("/") + "/"), rest)


def collisions(files: DataFrame, path: str, root: str, flatten: bool = True) -> DataFrame:
    """Destinations that more than one file would be written to."""
    return files.groupBy(destination(F.col(path), root, flatten).alias("dest_path")).agg(F.count("*").alias("files")).where("files > 1")
