"""The general data problems over the provided tables."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, incremental, intervals
from ..runtime import scratch, shared_folder, table, written

ENTRY_FIELDS = ["source_path", "size", "blake3_hash", "exported_at", "bad_sector_notes", "verified"]


def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export manifest against the destination's own copy, with the values that differ."""
    rules = {"dest_path": diff.slashes, "blake3_hash": diff.bare_hash, "exported_at": diff.whole_seconds, "bad_sector_notes": diff.blank_as_null}
    return diff.differences(
        table(spark, sf_dir, "proof_entries"),
        table(spark, sf_dir, "dest_entries"),
        ["manifest_id", "dest_path"],
        ENTRY_FIELDS,
        rules,
        right_version="scanned_at",
        only_left="missing_in_dest",
        only_right="missing_in_proof",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_differences(spark, sf_dir).select("manifest_id", "dest_path", "field")


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many targets of each manifest are tampered in which field, or missing."""
    return manifest_differences(spark, sf_dir).groupBy("manifest_id", "field").agg(F.count("*").alias("targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage(table(spark, sf_dir, "carved_files"), "image", "byte_offset", "size")


def _inputs(spark: SparkSession, *frames: DataFrame) -> dict[str, str]:
    """The files behind tables, with what tells that one was replaced."""
    out = {}
    for path in {p for df in frames for p in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        out[path] = f"{status.getLen()} {status.getModificationTime()}"
    return out


def _latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State left by the runs that count, kept in the shared folder from call to call.

    The current version is read and used as it is if no further run counts and no file has been added; else
    entries of runs that count since, or in files added since, are folded in and committed as the next version.
    Only where a file that was folded in is gone or replaced the state begins anew.
    """
    entries, runs = table(spark, sf_dir, "checkpoint_entries"), table(spark, sf_dir, "index_runs")
    now_there = _inputs(spark, entries, runs)
    store = incremental.StateStore(spark, f"{shared_folder(spark)}/tephra-state/v1/{hashlib.md5(sf_dir.encode()).hexdigest()}")
    while True:
        version = store.current()
        known = {r["path"]: r["mark"] for r in store.read("inputs", version).collect()} if version else {}
        if known and known == now_there:
            return store.read("state", version)
        goes_on = known and all(now_there.get(p) == m for p, m in known.items())
        counting = incremental.counting_runs(runs)
        kept = entries.withColumn("file", F.col("_metadata.file_name")).join(counting, "run_id", "left_semi")
        if goes_on:
            fresh = counting.join(store.read("runs", version), "run_id", "left_anti").withColumn("fresh", F.lit(True))
            added = sorted({unquote(p.rsplit("/", 1)[-1]) for p in now_there if p not in known})
            kept = kept.join(fresh, "run_id", "left").where(F.col("fresh") | F.col("file").isin(added))
        state = incremental.state_of(kept, "path", ["size", "modified"], {"hash": diff.bare_hash(kept["hash"])}, latest=["marked_at", "run_id"])
        if goes_on:
            state = incremental.merged(store.read("state", version), state)
        inputs = spark.createDataFrame(sorted(now_there.items()), "path string, mark string")
        try:
            store.commit({"state": state, "runs": counting, "inputs": inputs}, version)
        except incremental.StateConflict:
            continue


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files rows the next run has to process."""
    files = table(spark, sf_dir, "files")
    return incremental.new_or_changed(files, _latest_state(spark, sf_dir), "path", ["size", "modified"], {"hash": diff.bare_hash(files["hash"])})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("file_id", "path", "size", "modified", "hash")
    state = _latest_state(spark, sf_dir)
    return incremental.new_or_changed(files, state, "path", ["size", "modified"], {"hash": diff.bare_hash(files["hash"])}).select("file_id").distinct()


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that three runs process one after another: what was indexed when the last run finished, then all files, then all again."""
    files = table(spark, sf_dir, "files")
    finished = table(spark, sf_dir, "index_runs").where("status = 'completed'").agg(F.max("finished_at")).first()[0]
    store = incremental.StateStore(spark, scratch(spark, "runs"))
    early = files.where(F.col("indexed_at") <= F.lit(finished).cast("timestamp"))
    done = None
    for n, seen in enumerate((early, files, files), 1):
        took = incremental.run_once(seen, store, "path", ["size", "modified"], {"hash": diff.bare_hash})
        counted, _ = written(took.agg(F.lit(n).alias("run"), F.count_distinct("file_id").alias("files")), "run")
        done = counted if done is None else done.unionByName(counted)
    return done


QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary, "p6_found": p6_found, "p7_found": p7_found, "p7_runs": p7_runs}

_SIDES = r"""
WITH proof AS (
  SELECT DISTINCT manifest_id, replace(dest_path, '\', '/') AS dest_path, source_path, size, lower(trim(blake3_hash)) AS blake3_hash,
    date_trunc('second', exported_at) AS exported_at, CASE WHEN trim(bad_sector_notes) <> '' THEN bad_sector_notes END AS bad_sector_notes, verified
  FROM proof_entries),
scans AS (
  SELECT manifest_id, replace(dest_path, '\', '/') AS dest_path, source_path, size, lower(trim(blake3_hash)) AS blake3_hash,
    date_trunc('second', exported_at) AS exported_at, CASE WHEN trim(bad_sector_notes) <> '' THEN bad_sector_notes END AS bad_sector_notes, verified,
    row_number() OVER (PARTITION BY manifest_id, replace(dest_path, '\', '/') ORDER BY scanned_at DESC) AS rn
  FROM dest_entries),
both_sides AS (
  SELECT coalesce(p.manifest_id, d.manifest_id) AS manifest_id, coalesce(p.dest_path, d.dest_path) AS dest_path,
    p.manifest_id IS NULL AS no_proof, d.manifest_id IS NULL AS no_dest,
    p.source_path IS DISTINCT FROM d.source_path AS c1, p.size IS DISTINCT FROM d.size AS c2, p.blake3_hash IS DISTINCT FROM d.blake3_hash AS c3,
    p.exported_at IS DISTINCT FROM d.exported_at AS c4, p.bad_sector_notes IS DISTINCT FROM d.bad_sector_notes AS c5, p.verified IS DISTINCT FROM d.verified AS c6
  FROM proof p FULL JOIN (SELECT * FROM scans WHERE rn = 1) d ON p.manifest_id = d.manifest_id AND p.dest_path = d.dest_path),
listed AS (
  SELECT manifest_id, dest_path, 'missing_in_dest' AS field FROM both_sides WHERE no_dest
  UNION ALL SELECT manifest_id, dest_path, 'missing_in_proof' FROM both_sides WHERE no_proof
  UNION ALL SELECT manifest_id, dest_path, 'source_path' FROM both_sides WHERE c1 AND NOT no_dest AND NOT no_proof
  UNION ALL SELECT manifest_id, dest_path, 'size' FROM both_sides WHERE c2 AND NOT no_dest AND NOT no_proof
  UNION ALL SELECT manifest_id, dest_path, 'blake3_hash' FROM both_sides WHERE c3 AND NOT no_dest AND NOT no_proof
  UNION ALL SELECT manifest_id, dest_path, 'exported_at' FROM both_sides WHERE c4 AND NOT no_dest AND NOT no_proof
  UNION ALL SELECT manifest_id, dest_path, 'bad_sector_notes' FROM both_sides WHERE c5 AND NOT no_dest AND NOT no_proof
  UNION ALL SELECT manifest_id, dest_path, 'verified' FROM both_sides WHERE c6 AND NOT no_dest AND NOT no_proof)
"""

SQL = {
    "p2_found": _SIDES + "SELECT manifest_id, dest_path, field FROM listed",
    "p2_summary": _SIDES + "SELECT manifest_id, field, count(*) AS targets FROM listed GROUP BY 1, 2",
    "p6_found": """
WITH ext AS (SELECT image, byte_offset AS lo, byte_offset + size AS hi FROM carved_files WHERE size > 0 AND byte_offset IS NOT NULL),
seen AS (SELECT *, max(hi) OVER (PARTITION BY image ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ext),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM seen)
SELECT image, 'covered' AS kind, min(lo) AS start_offset, max(hi) AS end_offset FROM runs GROUP BY image, run
UNION ALL SELECT image, 'gap', before, lo FROM seen WHERE lo > before""",
    "p7_runs": """
WITH seen AS (SELECT file_id, coalesce(indexed_at <= (SELECT max(finished_at) FROM index_runs WHERE status = 'completed'), false) AS early FROM files)
SELECT 1 AS run, count(DISTINCT file_id) AS files FROM seen WHERE early
UNION ALL SELECT 2, count(DISTINCT file_id) FROM seen WHERE NOT early
UNION ALL SELECT 3, 0""",
    "p7_found": """
WITH RECURSIVE ok AS (
  SELECT run_id FROM index_runs WHERE status = 'completed'
  UNION SELECT r.resumed_from FROM index_runs r JOIN ok ON r.run_id = ok.run_id WHERE r.resumed_from IS NOT NULL),
latest AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY marked_at DESC, run_id DESC) AS rn FROM checkpoint_entries WHERE run_id IN (SELECT run_id FROM ok))
SELECT DISTINCT f.file_id FROM files f LEFT JOIN (SELECT * FROM latest WHERE rn = 1) e ON f.path = e.path
WHERE e.path IS NULL OR f.size IS DISTINCT FROM e.size OR f.modified IS DISTINCT FROM e.modified OR lower(trim(f.hash)) <> lower(trim(e.hash))""",
}
