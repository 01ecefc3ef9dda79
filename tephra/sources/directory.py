"""Directory trees as tables of files, hidden and empty ones included."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, modified timestamp, created timestamp, read_error string"


class _Shard(InputPartition):
    def __init__(self, directory: str, deep: bool):
        self.directory, self.deep = directory, deep


class DirectoryReader(DataSourceReader):
    """Walks shards: the files right in a directory, or all below it."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.hidden = options.get("hidden", "false") == "true"
        self.hidden_files = options.get("hidden_files", str(self.hidden)).lower() == "true"
        self.depth = int(options["max_depth"]) if "max_depth" in options else None
        self.extensions = {e.strip().lower().lstrip(".") for e in options.get("extensions", "").split(",") if e.strip()}
        self.one_system = options.get("same_file_system", "false") == "true"
        self.tasks = int(options.get("tasks", "256"))
        self.probe = options.get("probe", "true") == "true"

    def _below(self, directory: str) -> list[str]:
        """The directories right below one that are walked."""
        try:
            with os.scandir(directory) as entries:
                found = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and (self.hidden or not e.name.startswith(".")))
        except OSError:
            return []
        return [os.path.join(directory, d) for d in found]

    def partitions(self) -> list[InputPartition]:
        """Directories are opened level by level until there are enough of them, so that one deep tree isn't one task."""
        shards: list[InputPartition] = []
        open_ = [self.root]
        while open_ and len(shards) + len(open_) < self.tasks:
            shards += [_Shard(d, False) for d in open_]
            open_ = [c for d in open_ for c in self._below(d)]
        return shards + [_Shard(d, True) for d in open_]

    def _row(self, path: str) -> tuple:
        error = size = modified = created = None
        try:
            st = os.stat(path, follow_symlinks=False)
            size = st.st_size
            modified, created = (datetime.fromtimestamp(t, timezone.utc) for t in (st.st_mtime, st.st_ctime))
            if self.probe:
                with open(path, "rb") as f:
                    f.read(4096)
        except OSError as e:
            error = str(e)
        return path, size, modified, created, error

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        device = os.stat(self.root).st_dev
        for directory, below, files in os.walk(partition.directory):
            if self.one_system and os.stat(directory).st_dev != device:
                below[:] = []
                continue
            level = 0 if directory == self.root else os.path.relpath(directory, self.root).count(os.sep) + 1
            below[:] = sorted(
                d
                for d in below
                if partition.deep
                and (self.hidden or not d.startswith("."))
                and not os.path.islink(os.path.join(directory, d))
                and (not self.one_system or os.stat(os.path.join(directory, d)).st_dev == device)
            )
            if self.depth is not None and level + 1 > self.depth:
                below[:] = []
                continue
            for name in sorted(files):
                ext = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
                path = os.path.join(directory, name)
                if (self.hidden_files or not name.startswith(".")) and (not self.extensions or ext in self.extensions) and not os.path.islink(path):
                    yield self._row(path)


class DirectorySource(DataSource):
    """``spark.read.format("tephra_directory").load(path)``; options hidden, hidden_files, max_depth, extensions, same_file_system, probe, tasks (about how many)."""

    @classmethod
    def name(cls) -> str:
        return "tephra_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(dict(self.options))


def scan(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """One row per file below ``path``, spread over tasks by directory; files that can't be read have ``read_error``."""
    spark.dataSource.register(DirectorySource)
    return spark.read.format("tephra_directory").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(path)


def unreadable(scanned: DataFrame) -> DataFrame:
    """The files of a scan that couldn't be read, as bad-sector records."""
    return scanned.where("read_error IS NOT NULL").selectExpr("path AS file_path", "CAST(0 AS LONG) AS offset", "coalesce(size, 0) AS length", "read_error AS error", "0 AS retry_count", "4096 AS block_size")


def failures(scanned: DataFrame, agent: str = "Scan", retries: int = 3) -> DataFrame:
    """The files of a scan that couldn't be read, as failures to be tried again (``state.heal``)."""
    return scanned.where("read_error IS NOT NULL").select(F.lit(agent).alias("agent"), F.col("path").alias("source"), F.col("read_error").alias("error"), F.lit(retries).alias("retries_left"))
