"""Structured Streaming forms of what the batch operators do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..operators import incremental


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Scans (Parquet files) as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def incremental_index(scans: DataFrame, out: str, state: str, checkpoint: str, fields: Sequence[str] = ("size", "modified")) -> StreamingQuery:
    """Write what is new or changed of every batch to ``out``/batch=N and move the state on.

    A batch is written whole over what an earlier attempt at it left; only then the state is swapped, so a
    failure at any point repeats or skips nothing in ``out``. The state holds which batch it is of, and a
    batch found in it is not done again.
    """

    def upsert(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        store = incremental.StateStore(spark, state)
        version = store.current()
        before = store.read(version=version)
        done = before.agg(F.max("batch")).first()[0] if before is not None else None
        if done is not None and done >= number:
            return
        known = before.drop("batch") if before is not None else None
        fresh = incremental.new_or_changed(rows, known, "path", list(fields))
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        now = incremental.state_of(rows, "path", list(fields), latest=[f for f in fields if f == "modified"]).select("key", "content_hash")
        if known is not None:
            now = known.join(now.select("key"), "key", "left_anti").unionByName(now)
        store.commit(now.withColumn("batch", F.lit(number).cast("long")), version)

    return scans.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(scans: DataFrame, name: str) -> StreamingQuery:
    """Files and bytes per kind so far, as an in-memory table ``name``."""
    kinds = scans.withColumn("kind", names.file_type(names.extension(F.col("path"))))
    totals = kinds.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def session_stream(events: DataFrame) -> DataFrame:
    """State of each session after every batch: session, files_done, files_failed, ended, from events (session, at, kind).

    The state is four numbers per session. An event counts once per batch it comes in.
    """
    schema = "session string, files_done long, files_failed long, ended boolean"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, failed, last, ended = state.get if state.exists else (0, 0, 0.0, False)
        for p in parts:
            done += int((p["kind"] == "FileCompleted").sum())
            failed += int((p["kind"] == "FileFailed").sum())
            newest = p.loc[p["at"].idxmax()]
            if newest["at"].timestamp() >= last:
                last, ended = newest["at"].timestamp(), bool(newest["kind"] == "Completed")
        state.update((done, failed, last, ended))
        yield pd.DataFrame({"session": [key[0]], "files_done": [done], "files_failed": [failed], "ended": [ended]})

    return events.groupBy("session").applyInPandasWithState(fold, schema, "done long, failed long, last double, ended boolean", "update", "NoTimeout")
