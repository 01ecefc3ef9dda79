"""Logs of sessions, runs and retries folded to state."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts


def session_states(events: DataFrame, session: str, at: str, kind: str, done: str = "FileCompleted", failed: str = "FileFailed", ended: str = "Completed") -> DataFrame:
    """State of each session by replaying its events: files done and failed, first and last event, and whether the last says it ended."""
    k = F.col(kind)
    out = events.groupBy(session).agg(
        F.count_if(k == done).alias("files_done"),
        F.count_if(k == failed).alias("files_failed"),
        F.min(at).alias("created_at"),
        F.max(at).alias("updated_at"),
        F.max(F.struct(at, kind)).alias("last"),
    )
    return out.withColumn("status", F.when(F.col(f"last.{kind}") == ended, "Completed").otherwise("Running")).drop("last")


def log_summary(log: DataFrame, result: str) -> DataFrame:
    """Entries of a repair log by result."""
    return log.groupBy(result).agg(F.count("*").alias("entries"))


def pending_retries(log: DataFrame) -> DataFrame:
    """Entries of a repair log that a resumed run tries again."""
    return log.where((F.col("result") == "Retrying") & (F.col("retries_left") > 0))


def failed_entries(log: DataFrame) -> DataFrame:
    """Entries of a repair log that failed for good."""
    return log.where(F.col("result") == "Failed")


def retry_schedule(failures: DataFrame, key: str, error: str, retries: int = 3, first_ms: int = 100, cap_ms: int = 5000) -> DataFrame:
    """The attempts each failure would get: ``key``, attempt, delay_ms, repair; none for errors no retry can mend."""
    mendable = failures.where(texts.is_recoverable(F.col(error)))
    rows = mendable.select(key, error, F.explode(F.sequence(F.lit(0), F.lit(retries - 1))).alias("attempt"))
    return rows.select(key, "attempt", texts.retry_delay_ms(F.col("attempt"), first_ms, 2, cap_ms).alias("delay_ms"), texts.repair_for(F.col(error)).alias("repair"))


def heal(failures: DataFrame, attempt: Callable[[str, str, str], str | None], max_retries: int = 3, first_ms: int = 100, cap_ms: int = 5000, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Try failures (agent, source, error, retries_left) again and give the entries of the repair log.

    An error no retry can mend is Skipped; without retries left a failure is Failed; else, after an exponential
    delay, ``attempt(agent, source, repair)`` tries the work again with the repair the error asks for and gives
    None, which is Healed, or the next error, which is Retrying with one retry less. A source has one entry per
    decision, the last of which is final. Failures are spread over the tasks as they come; a task that is
    repeated tries again, so attempts must bear repetition. NULL retries_left is ``max_retries``.
    """
    rows = failures.select("agent", "source", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("retries_left", F.lit(max_retries)).cast("int").alias("retries_left"))
    schema = "timestamp timestamp, agent string, source string, error string, retries_left int, result string, duration_ms long"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log: list[tuple] = []
            for r in batch.to_pylist():
                error, left, result = r["error"], r["retries_left"], "Retrying"
                while result == "Retrying":
                    began, low = time.monotonic(), error.lower()
                    said = error
                    if any(f in low for f in texts.FATAL_ERRORS):
                        result = "Skipped"
                    elif left <= 0:
                        result, left = "Failed", 0
                    else:
                        pause(min(first_ms * 2 ** max(max_retries - left, 0), cap_ms) / 1000)
                        repair = next((name for name, parts in texts.REPAIRS if any(x in low for x in parts)), "generic")
                        after = attempt(r["agent"], r["source"], repair)
                        left -= 1
                        result, error = ("Healed", error) if after is None else ("Retrying", after)
                    log.append((dt.datetime.now(dt.UTC), r["agent"], r["source"], said, left, result, int((time.monotonic() - began) * 1000)))
            kinds = [pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()]
            cols = list(zip(*log)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["timestamp", "agent", "source", "error", "retries_left", "result", "duration_ms"])

    return rows.mapInArrow(go, schema)


def resume_pending(log: DataFrame, attempt: Callable[[str, str, str], str | None], **more) -> DataFrame:
    """``heal`` for what a log left pending: sources whose last entry is Retrying with retries left."""
    last = log.groupBy("agent", "source").agg(F.max_by(F.struct("error", "retries_left", "result"), F.struct("timestamp", -F.col("retries_left"))).alias("r")).select("agent", "source", "r.*")
    return heal(pending_retries(last), attempt, **more)


def resumable(runs: DataFrame, source: str, run: str, started: str, status: str, ended: str = "completed") -> DataFrame:
    """The newest run of each source that hasn't ended, by an aggregate."""
    return runs.where(F.coalesce(F.col(status), F.lit("")) != ended).groupBy(source).agg(F.max_by(run, F.struct(started, run)).alias(run))


def beyond_newest(runs: DataFrame, source: str, run: str, started: str, keep: int) -> DataFrame:
    """Runs of each source older than its ``keep`` newest."""
    order = Window.partitionBy(source).orderBy(F.desc(started), F.desc(run))
    return runs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") > keep).drop("__n")
