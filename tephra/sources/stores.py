"""Tables and documents that are kept: index, manifests, checkpoints, logs, settings."""

from __future__ import annotations

import hashlib
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import DISK_IMAGES
from ..operators import proof
from .sessions import AutoSave

VERSION = 1
MANIFEST = (
    "version int, tool string, created_at string, source_root string, dest_root string, root_hash string, "
    "entries array<struct<source_path: string, dest_path: string, size: long, hash: string, exported_at: timestamp, bad_sector_notes: string, verified: boolean>>"
)
HEAL_LOG = "timestamp timestamp, agent string, source string, error string, retries_left int, result string, duration_ms long"


def index_path(root: str, source: str) -> str:
    """Where the index of a source is kept."""
    return f"{root.rstrip('/')}/{hashlib.sha256(source.encode()).hexdigest()[:16]}/index.parquet"


def load_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or one without rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def save_manifest(entries: DataFrame, path: str, source_root: str, dest_root: str, tool: str = "tephra") -> None:
    """Write entries as JSON lines, one per entry, beside a line of totals and root hash: ``path``/entries and ``path``/head.

    The head is computed from what was written, so entries that are made by copying files are made once.
    """
    entries.write.mode("overwrite").json(f"{path}/entries")
    one = load_manifest(entries.sparkSession, path).select(F.lit(0).alias("m"), "source_path", "hash", "size", "verified")
    head = proof.totals(one, "m").join(proof.root_hashes(one, "m", "source_path", "hash"), "m").drop("m")
    named = head.withColumns({"version": F.lit(VERSION), "tool": F.lit(tool), "source_root": F.lit(source_root), "dest_root": F.lit(dest_root)})
    named.coalesce(1).write.mode("overwrite").json(f"{path}/head")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest of ``save_manifest``, or of a single JSON document that holds them."""
    if path.endswith(".json"):
        whole = spark.read.schema(MANIFEST).json(path, multiLine=True)
        return whole.select(F.explode("entries").alias("e")).select("e.*")
    return spark.read.schema("source_path string, dest_path string, size long, hash string, exported_at timestamp, bad_sector_notes string, verified boolean").json(f"{path}/entries")


def root_hash_valid(spark: SparkSession, path: str) -> bool:
    """Whether the entries still have the root hash of the head."""
    told = spark.read.json(f"{path}/head").first()["root_hash"]
    now = proof.root_hashes(load_manifest(spark, path).withColumn("m", F.lit(0)), "m", "source_path", "hash").first()
    return (now["root_hash"] if now else None) == told


def load_heal_log(spark: SparkSession, path: str) -> DataFrame:
    """A repair log of JSON lines."""
    return spark.read.schema(HEAL_LOG).json(path)


def append_heal_log(rows: DataFrame, path: str) -> None:
    """Add to a repair log."""
    rows.write.mode("append").json(path)


def load_checkpoint(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """Processed paths of a phase; those of another version don't count."""
    rows = load_or_empty(spark, path, "path string, hash string, phase string, version int")
    return rows.where((F.col("version") == VERSION) & (F.col("phase") == phase)).select("path", "hash").distinct()


def mark_processed(rows: DataFrame, path: str, phase: str) -> None:
    """Add processed paths (path, hash) to a checkpoint."""
    rows.select("path", "hash", F.lit(phase).alias("phase"), F.lit(VERSION).alias("version")).write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> bool:
    """Delete a kept table, such as a checkpoint or a search index; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


class Checkpoint:
    """Processed paths of a phase that are added one by one and saved every so many, or every so many seconds."""

    def __init__(self, spark: SparkSession, path: str, phase: str, every: int = 100, seconds: float = 30.0):
        self.spark, self.path, self.phase = spark, path, phase
        self._auto, self._rows = AutoSave(every, seconds), []

    def mark(self, path: str, digest: str | None = None) -> None:
        self._rows.append((path, digest))
        if self._auto.due():
            self.save()

    def save(self) -> None:
        if self._rows:
            mark_processed(self.spark.createDataFrame(self._rows, "path string, hash string"), self.path, self.phase)
            self._rows = []


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text: source, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def load_settings(path: str) -> dict:
    """Settings from TOML, with their defaults."""
    settings: dict = {"scan": {"hidden": False, "workers": 8}, "export": {"verify": True, "concurrent": 8}, "search": {"limit": 100}}
    if os.path.exists(path):
        with open(path, "rb") as f:
            for section, values in tomllib.load(f).items():
                settings.setdefault(section, {}).update(values)
    return settings


def save_settings(settings: dict, path: str) -> None:
    """Write settings as TOML."""
    as_text = lambda v: str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    with open(path, "w") as f:
        for section, values in settings.items():
            f.write(f"[{section}]\n" + "".join(f"{k} = {as_text(v)}\n" for k, v in values.items()) + "\n")


def disk_images(folder: str, least: int = 1 << 20) -> list[str]:
    """Disk images of some size right in a folder."""
    with os.scandir(folder) as entries:
        return sorted(e.path for e in entries if e.is_file() and e.name.rsplit(".", 1)[-1].lower() in DISK_IMAGES.split() and e.stat().st_size > least)
