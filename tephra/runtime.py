"""What operators need from the session: the shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests), a temporary folder is made and given to the
    session as checkpoint folder; on a cluster an unset one is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        made = tempfile.mkdtemp(prefix="tephra-")
        atexit.register(shutil.rmtree, made, True)
        context.setCheckpointDir(made)
        _OWN[context.applicationId] = "file://" + made
    return _OWN[context.applicationId]


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; what is left there goes when the application ends."""
    base = f"{shared_folder(spark)}/tephra/{spark.sparkContext.applicationId}"
    if base not in _MARKED:
        _MARKED.add(base)
        p = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
