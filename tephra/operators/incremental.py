"""Processing only new or changed records, against a persisted and versioned state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import forget, written


class StateConflict(Exception):
    """Another writer has made the version that this one was to follow obsolete."""


class StateStore:
    """Versions of the tables of a state under one folder, the highest being current.

    A version is first written whole, to a folder of its own, then claimed: a file that names the folder appears
    under the version's number, in one atomic step that fails if the number is taken. So a run that dies earlier
    leaves the old version current and the next run sees the same changes again, and of two writers that follow
    the same version one wins and the other gets StateConflict, with nothing of the state lost or mixed.

    Only file systems with an atomic rename that refuses an existing target can do that; others are refused.
    """

    #: Schemes of file systems that can claim a version.
    SCHEMES = ("file", "hdfs", "viewfs")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.scheme = self._files.getUri().getScheme()
        if self.scheme not in self.SCHEMES:
            raise ValueError(f"a state needs a file system with atomic rename, not {self.scheme}")

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self._files.listStatus(p)) if self._files.exists(p) else []

    def _versions(self) -> list[int]:
        return [int(n) for n in self._names("claims") if n.isdigit()]

    def current(self) -> int:
        """The number of the current version; 0 before the first commit."""
        return max(self._versions(), default=0)

    def _place(self, version: int) -> str:
        stream = self._files.open(self._path(f"claims/{version:010d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str = "state", version: int | None = None) -> DataFrame | None:
        """A table of the current or of the given version; None where there is none."""
        version = version or self.current()
        if not version:
            return None
        path = f"{self.folder}/data/{self._place(version)}/{name}"
        return self.spark.read.parquet(path) if self._files.exists(self._hadoop.Path(path)) else None

    def commit(self, tables: dict[str, DataFrame] | DataFrame, after: int, keep: int = 2) -> int:
        """Write ``tables`` as the version that follows ``after`` and make it current; all but the last ``keep`` versions are deleted."""
        version = after + 1
        place = f"{version:010d}-{uuid.uuid4().hex}"
        for name, df in (tables if isinstance(tables, dict) else {"state": tables}).items():
            df.write.parquet(f"{self.folder}/data/{place}/{name}")
        if not self._claim(version, place):
            self._files.delete(self._path(f"data/{place}"), True)
            raise StateConflict(f"version {version} is taken")
        self._expire(keep)
        return version

    def _claim(self, version: int, place: str) -> bool:
        temporary, claim = self._path(f"claims/{place}.new"), self._path(f"claims/{version:010d}")
        self._files.mkdirs(temporary.getParent())
        out = self._files.create(temporary, False)
        out.write(bytearray(place.encode()))
        out.close()
        try:
            if self.scheme == "file":  # a link can't replace a file, a local rename would
                os.link(temporary.toUri().getPath(), claim.toUri().getPath())
            else:
                context = self._hadoop.FileContext.getFileContext(claim.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(temporary, claim, self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0))
        except (FileExistsError, Py4JJavaError):
            if not self._files.exists(claim):
                raise
            return False
        finally:
            self._files.delete(temporary, False)
        if self.current() > version:  # the number was free only because it had expired
            self._files.delete(claim, False)
            return False
        return True

    def _expire(self, keep: int) -> None:
        """Delete older versions, and what attempts at versions that others claimed have left."""
        now = self.current()
        kept = {self._place(v) for v in self._versions() if v > now - max(keep, 1)}
        for v in self._versions():
            if v <= now - max(keep, 1):
                self._files.delete(self._path(f"claims/{v:010d}"), False)
        for name in self._names("data"):
            if int(name.split("-")[0]) <= now and name not in kept:
                self._files.delete(self._path(f"data/{name}"), True)


def content_hash(*fields: Column) -> Column:
    """128 bits over the fields; NULL differs from every value."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.hex(f.cast("string").cast("binary")))) for f in fields]
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def exact_text(c: Column, kind: str) -> Column:
    """Timestamps as microseconds, so that their text loses nothing; others as they are."""
    return F.unix_micros(c) if kind == "timestamp" else c


def state_of(df: DataFrame, key: str, fields: Sequence[str], lenient: dict[str, Column] | None = None, latest: Sequence[str] = ()) -> DataFrame:
    """The state that ``df`` amounts to: one row per key with what ``latest`` is for it, content_hash and the lenient values.

    Of several rows of a key the greatest by ``latest`` counts, ties go to the greatest by content.
    Rows with a NULL key leave no state.
    """
    kinds = dict(df.dtypes)
    soft = [v.alias(f"lenient_{i}") for i, v in enumerate((lenient or {}).values())]
    rows = df.where(df[key].isNotNull()).select(
        df[key].alias("key"),
        *(df[c].alias(f"order_{i}") for i, c in enumerate(latest)),
        content_hash(*(exact_text(df[c], kinds[c]) for c in fields)).alias("content_hash"),
        *soft,
    )
    best = rows.groupBy("key").agg(F.max(F.struct(*rows.columns[1:])).alias("row"))
    return best.select("key", *(F.col(f"row.{c}").alias(c) for c in rows.columns[1:]))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several over the same columns; of a key's rows the greatest by its order columns counts."""
    rows = reduce(DataFrame.unionByName, states)
    best = rows.groupBy("key").agg(F.max(F.struct(*rows.columns[1:])).alias("row"))
    return best.select("key", *(F.col(f"row.{c}").alias(c) for c in rows.columns[1:]))


def new_or_changed(df: DataFrame, state: DataFrame | None, key: str, fields: Sequence[str], lenient: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``df``, whole, whose key isn't in ``state`` or whose content differs.

    ``fields`` are compared by content hash, where NULL equals NULL only; a ``lenient`` expression differs
    only where both sides have a value. One shuffle by key joins the two; the state carries 16 bytes of
    hash in place of the fields.

    Defined results: rows repeated word for word come out once; a NULL key is never in the state, so such
    rows always come out; no state (a first run) brings out everything; extra columns pass through whatever
    they are called.
    """
    if state is None:
        return df.distinct()
    kinds = dict(df.dtypes)
    mine = df.select(
        F.struct(*(df[c] for c in df.columns)).alias("row"),
        df[key].alias("my_key"),
        content_hash(*(exact_text(df[c], kinds[c]) for c in fields)).alias("my_hash"),
        *(v.alias(f"my_{i}") for i, v in enumerate((lenient or {}).values())),
    )
    met = mine.join(state, F.col("my_key") == F.col("key"), "left")
    differs = F.col("key").isNull() | (F.col("my_hash") != F.col("content_hash"))
    for i in range(len(lenient or {})):
        differs = differs | F.coalesce(F.col(f"my_{i}") != F.col(f"lenient_{i}"), F.lit(False))
    return met.where(differs).select("row.*").distinct()


def run_once(df: DataFrame, store: StateStore, key: str, fields: Sequence[str], lenient: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Process what is new or changed in ``df`` since the version that is current, and commit it; returns these rows.

    The changed rows and the state that follows are parts of one version, so both become visible in the same
    step: a run that dies at any point before leaves no trace that a later run would take for done, and none
    that it would do twice. The state moves on by the changed rows alone. Raises StateConflict if another run
    was faster; nothing of this one counts then. Keys that vanished from ``df`` stay in the state. Of different
    rows of one key all come out and the greatest by content is remembered. ``lenient`` has a normaliser by column.
    """
    soft = lambda rows: {n: f(rows[n]) for n, f in (lenient or {}).items()}
    now = store.current()
    before = store.read(version=now)
    fresh, at = written(new_or_changed(df, before, key, fields, soft(df)), "fresh")
    after = state_of(fresh, key, fields, soft(fresh))
    if before is not None:
        after = before.join(after.select("key"), "key", "left_anti").unionByName(after)
    version = store.commit({"changes": fresh, "state": after}, now)
    forget(df.sparkSession, at)
    return store.read("changes", version)


def counting_runs(runs: DataFrame, run: str = "run_id", status: str = "status", taken_from: str = "resumed_from", done: str = "completed") -> DataFrame:
    """``run``: runs that completed, or that a completed run took over, directly or over further runs.

    The flag moves along ``taken_from`` with pointer doubling: after n rounds it has gone 2^n - 1 steps, and
    a round that adds none proves the end, also where broken data form a ring. Each round is written to the
    shared folder. Repeated rows are one; a run with several rows counts if one of them completed.
    """
    spark = runs.sparkSession
    rows = runs.select(runs[run].alias("id"), runs[taken_from].alias("up"), F.coalesce(runs[status] == done, F.lit(False)).alias("counts"))
    flags, at = written(rows.where("id IS NOT NULL").groupBy("id").agg(F.max("counts").alias("counts")), "flags")
    jumps, jumps_at = written(rows.where("id IS NOT NULL AND up IS NOT NULL").select("id", "up").distinct(), "jumps")
    n = flags.where("counts").count()
    while True:
        lifted = jumps.join(flags.where("counts").select("id"), "id").select(F.col("up").alias("id")).withColumn("counts", F.lit(True))
        after, after_at = written(flags.unionByName(lifted).groupBy("id").agg(F.max("counts").alias("counts")), "flags")
        m = after.where("counts").count()
        forget(spark, at)
        flags, at = after, after_at
        if m == n:
            break
        n = m
        far = jumps.alias("a").join(jumps.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", "b.up").distinct()
        longer, longer_at = written(far, "jumps")
        forget(spark, jumps_at)
        jumps, jumps_at = longer, longer_at
    return flags.where("counts").select(F.col("id").alias(run))
