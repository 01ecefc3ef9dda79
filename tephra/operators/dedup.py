"""Exact and fuzzy duplicates of an index, the copy to keep, and what removing the others frees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..runtime import parallelism

KEEP = ("newest", "largest", "oldest", "cleanest")


def keep_score(keep: str) -> Column:
    """The higher, the rather a copy is kept; names of temporary copies count against it."""
    seconds = F.unix_seconds(F.col("modified"))
    clean = (~names.is_temp_name(F.col("path"))).cast("long")
    if keep == "newest":
        return F.coalesce(seconds, F.lit(0)) + clean
    if keep == "largest":
        return F.col("size") + clean
    if keep == "oldest":
        return F.coalesce(-seconds, F.lit(-(1 << 62))) + clean
    if keep == "cleanest":
        return clean * 1000 + F.coalesce(F.expr("unix_seconds(modified) div 1000000"), F.lit(0))
    raise ValueError(keep)


def _scored(files: DataFrame, keep: str, min_size: int) -> DataFrame:
    return files.where((F.col("size") >= min_size) & F.col("hash").isNotNull()).select("size", F.lower(F.trim("hash")).alias("hash"), "path", keep_score(keep).alias("score"))


def exact_groups(files: DataFrame, keep: str = "newest", min_size: int = 1) -> DataFrame:
    """Groups of equal size and hash: hash, size, files, wasted_bytes, master. Ties of the master go to the first path.

    Groups are counted and their master found by aggregates that start before the shuffle; no list of members
    is built, so a group of a third of all files is one small row. ``exact_members`` gives the members.
    """
    rows = _scored(files, keep, min_size).withColumn("neg", -F.col("score"))
    return (
        rows.groupBy("size", "hash")
        .agg(F.count("*").alias("files"), F.min(F.struct("neg", "path")).alias("best"))
        .where("files > 1")
        .select("hash", "size", "files", (F.col("size") * (F.col("files") - 1)).alias("wasted_bytes"), F.col("best.path").alias("master"))
    )


def exact_members(files: DataFrame, groups: DataFrame, min_size: int = 1) -> DataFrame:
    """Every file of a group: hash, size, path, role (master or duplicate)."""
    rows = files.where((F.col("size") >= min_size) & F.col("hash").isNotNull()).select("size", F.lower(F.trim("hash")).alias("hash"), "path")
    return rows.join(groups.select("size", "hash", "master"), ["size", "hash"]).select("hash", "size", "path", F.when(F.col("path") == F.col("master"), "master").otherwise("duplicate").alias("role"))


def report(files: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: scanned, groups, duplicates, unique (scanned less duplicates), wasted bytes."""
    found = groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("files") - 1), F.lit(0)).alias("total_duplicates"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))
    return files.agg(F.count("*").alias("scanned_files")).join(found, how="cross").withColumn("unique_files", F.col("scanned_files") - F.col("total_duplicates"))


def purge_plan(files: DataFrame, groups: DataFrame) -> DataFrame:
    """What a purge would delete: path and bytes. Nothing is deleted here."""
    return exact_members(files, groups).where("role = 'duplicate'").select("path", "size")


def fuzzy_members(files: DataFrame, threshold: int = 85, min_size: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """Files whose names agree once marks of copies are stripped, clustered by size: norm, cluster, path, size, reference, similarity.

    Within a name, in order of path, a file joins the first cluster whose first file's size is near enough,
    else opens one. The rows of a name are streamed in order through one task and only the sizes of its
    clusters are held, which the threshold bounds, however many files share the name.
    ``exclude`` is taken away first (files already in exact groups).
    """
    rows = files.where(F.col("size") >= min_size)
    if exclude is not None:
        rows = rows.join(exclude.select("path").distinct(), "path", "left_anti")
    rows = rows.select(names.normalised_name(F.col("path")).alias("norm"), "path", "size")
    ordered = rows.repartition(parallelism(files.sparkSession), "norm").sortWithinPartitions("norm", "path")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, firsts = None, []
        for batch in batches:
            cluster, reference, near = [], [], []
            for norm, size in zip(batch.column("norm").to_pylist(), batch.column("size").to_pylist()):
                if norm != current:
                    current, firsts = norm, []
                for i, first in enumerate(firsts):
                    share = min(size * 100 // first, 255)
                    alike = share if share <= 100 else max(0, 200 - share)
                    if alike >= threshold:
                        break
                else:
                    i, first, alike = len(firsts), size, 100
                    firsts.append(size)
                cluster.append(i)
                reference.append(first)
                exact = size * 100.0 / first
                near.append(exact if exact <= 100 else 200 - exact)
            arrays = [*(batch.column(c) for c in ("norm", "path", "size")), pa.array(cluster, pa.int32()), pa.array(reference, pa.int64()), pa.array(near, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["norm", "path", "size", "cluster", "reference", "similarity"])

    return ordered.mapInArrow(walk, "norm string, path string, size long, cluster int, reference long, similarity double")


def fuzzy_groups(files: DataFrame, threshold: int = 85, min_size: int = 1, exclude: DataFrame | None = None, keep: str = "newest") -> DataFrame:
    """Clusters of two files or more: norm, cluster, files, similarity (mean, cut to whole percent), wasted_bytes, master."""
    members = fuzzy_members(files, threshold, min_size, exclude)
    scores = files.where(F.col("size") >= min_size).select("path", (-keep_score(keep)).alias("neg"))
    rows = members.join(scores, "path")
    return (
        rows.groupBy("norm", "cluster")
        .agg(F.count("*").alias("files"), F.floor(F.avg("similarity")).cast("int").alias("similarity"), F.sum("size").alias("all_bytes"), F.min(F.struct("neg", "path", "size")).alias("best"))
        .where("files > 1")
        .select("norm", "cluster", "files", "similarity", (F.col("all_bytes") - F.col("best.size")).alias("wasted_bytes"), F.col("best.path").alias("master"))
    )


def all_groups(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Exact and fuzzy groups in one report, the most wasteful first: kind, name, similarity, files, wasted_bytes, master.

    The two are disjoint if the fuzzy groups were made without the members of the exact ones.
    """
    columns = ("name", "similarity", "files", "wasted_bytes", "master")
    one = exact.select(F.lit("exact").alias("kind"), F.col("hash").alias("name"), F.lit(100).alias("similarity"), *columns[2:])
    two = fuzzy.select(F.lit("fuzzy").alias("kind"), F.concat_ws("#", "norm", "cluster").alias("name"), *columns[1:])
    return one.unionByName(two).orderBy(F.desc("wasted_bytes"), "kind", "name")
