"""Sessions of long jobs: kept, listed, resumed and deleted."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import StateStore

HEAD = "session string, source string, status string, created_at timestamp, updated_at timestamp"


class SessionStore:
    """Sessions under one folder, a version store each: a head of one row and a table of files.

    A save is a version that becomes current in one step, so a session that is read is always whole; a save
    that dies leaves the one before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _store(self, session: str) -> StateStore:
        if not session or "/" in session or session.startswith("."):
            raise ValueError(f"not a name for a session: {session!r}")
        return StateStore(self.spark, f"{self.folder}/{session}")

    def save(self, head: dict, files: DataFrame) -> int:
        """Keep a session: its head (the columns of HEAD) and its files (any columns)."""
        store = self._store(head["session"])
        columns = [c.split()[0] for c in HEAD.split(", ")]
        return store.commit({"head": self.spark.createDataFrame([tuple(head.get(c) for c in columns)], HEAD), "files": files}, store.current())

    def load(self, session: str) -> tuple[Row, DataFrame] | None:
        """Head and files of a session; None if there is none."""
        store = self._store(session)
        version = store.current()
        return (store.read("head", version).first(), store.read("files", version)) if version else None

    def sessions(self) -> DataFrame:
        """Heads of all sessions, the newest first."""
        names = sorted(s.getPath().getName() for s in self._files.listStatus(self._root)) if self._files.exists(self._root) else []
        stores = [(s, s.current()) for s in map(self._store, names)]
        paths = [f"{s.folder}/data/{s._place(v)}/head" for s, v in stores if v]
        heads = self.spark.read.schema(HEAD).parquet(*paths) if paths else self.spark.createDataFrame([], HEAD)
        return heads.orderBy(F.desc("updated_at"), "session")

    def resumable(self, source: str) -> Row | None:
        """The newest session of a source that hasn't completed."""
        return self.sessions().where((F.col("source") == source) & (F.col("status") != "Completed")).first()

    def delete(self, sessions: Sequence[str]) -> int:
        """Delete sessions; the number of those that were there."""
        return sum(bool(self._files.delete(self._store(s)._path(""), True)) for s in sessions)

    def keep_newest(self, n: int) -> int:
        """Delete completed sessions but for the ``n`` newest."""
        done = [r["session"] for r in self.sessions().where("status = 'Completed'").toLocalIterator()]
        return self.delete(done[n:])


@dataclass
class AutoSave:
    """When to save: after so many items or so many seconds, whichever is first."""

    every_items: int = 100
    every_seconds: float = 30.0
    items: int = 0
    last: float = field(default_factory=time.monotonic)

    def due(self, items: int = 1, now: float | None = None) -> bool:
        """Count ``items`` more; True, and begin anew, if a save is due."""
        now = time.monotonic() if now is None else now
        self.items += items
        if self.items < self.every_items and now - self.last < self.every_seconds:
            return False
        self.items, self.last = 0, now
        return True
