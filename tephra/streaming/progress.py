"""Progress of streams as callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls ``tell(name, batch, rows so far, rows a second)`` after every batch, and ``ended(name, error)`` at the end."""

    def __init__(self, tell: Callable[[str | None, int, int, float], None], ended: Callable[[str | None, str | None], None] = lambda name, error: None):
        self.tell, self.ended = tell, ended
        self.rows: dict[str, int] = {}
        self.names: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        self.tell(p.name, p.batchId, self.rows[run], p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(self.names.get(str(event.runId)), event.exception)


def listen(spark: SparkSession, tell, ended=lambda name, error: None) -> Progress:
    """Follow all streams of a session; ``spark.streams.removeListener`` ends it."""
    progress = Progress(tell, ended)
    spark.streams.addListener(progress)
    return progress
