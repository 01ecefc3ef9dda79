"""Carving, manifest, sector and log queries over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.signatures import SIGNATURES, little_endian
from ..operators import carve, diff, proof, sectors, state
from ..runtime import table

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Carving. The UTF-8 bytes of the documents serve as images.
_SIGNATURES = "sig(idx, name, header, off) AS (VALUES " + ", ".join(f"({i}, '{s.name}', '{s.header.hex().upper()}', {s.offset})" for i, s in enumerate(SIGNATURES)) + ")"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))


@_query(
    f"""WITH {_SIGNATURES},
img AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
pos AS (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS p FROM img),
m AS (SELECT doc_id, p, name, row_number() OVER (PARTITION BY doc_id, p ORDER BY off > 0, idx) AS rn
  FROM pos JOIN sig ON substr(h, 2 * (p + off) + 1, length(header)) = header)
SELECT doc_id, p AS offset, name AS signature, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p), -1) AS following FROM m WHERE rn = 1"""
)
def carve_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carve.hits(_images(spark, sf_dir), "doc_id", F.col("content"), F.lit(0), F.octet_length("content")).withColumn("following", F.coalesce("following", F.lit(-1)))


@_query(
    f"""WITH {_SIGNATURES},
img AS (SELECT doc_id, 'FFD8FFE0' || hex(encode(text)) || 'FFD9' AS h FROM documents WHERE text IS NOT NULL),
pos AS (SELECT doc_id, h, unnest(range(512, length(h) // 2, 512)) AS p FROM img),
inner_hit AS (SELECT doc_id, min(p) AS p FROM pos JOIN sig ON substr(h, 2 * (p + off) + 1, length(header)) = header GROUP BY doc_id)
SELECT doc_id, 0 AS "offset", coalesce(p, length(h) // 2) AS size, 'JPEG' AS signature_name, 'jpg' AS extension, 'Image' AS file_type,
  CASE WHEN p IS NULL THEN 'FooterScan' ELSE 'NextHeader' END AS boundary_method
FROM img LEFT JOIN inner_hit USING (doc_id) WHERE p IS NOT NULL OR length(h) // 2 - 2 >= 64"""
)
def carve_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document between the header and the footer of a JPEG, with what else starts at a sector inside it."""
    whole = F.concat(F.unhex(F.lit("FFD8FFE0")), F.col("content"), F.unhex(F.lit("FFD9")))
    return carve.carve_column(_images(spark, sf_dir).where("content IS NOT NULL"), "doc_id", whole, carve.CarveOptions(min_size=64))


#: Images of so many bytes with parts (offset, hex) in them.
_CASES = {
    "footer": (4096, [(0, "FFD8FFE0"), (2000, "FFD9")]),
    "size field": (8192, [(0, "424D00040000")]),
    "next header": (8192, [(0, "FFD8FFE0"), (4096, "FFD8FFE0"), (6000, "FFD9")]),
    "wave": (2048, [(0, "52494646F401000057415645")]),
    "avi": (2048, [(0, "52494646F401000041564920")]),
    "chunks": (2048, [(0, "89504E470D0A1A0A0000000D49484452"), (33, "0000006449444154"), (145, "0000000049454E44")]),
    "end record": (2048, [(0, "504B0304"), (500, "504B0506"), (520, "0700")]),
    "too small": (64, [(0, "FFD8FFE0"), (20, "FFD9")]),
    "nothing": (65536, []),
}


@_query(
    """SELECT * FROM (VALUES ('footer', 0, 2002, 'jpg', 'FooterScan'), ('size field', 0, 1024, 'bmp', 'InternalSize'), ('next header', 0, 4096, 'jpg', 'NextHeader'), ('next header', 4096, 1906, 'jpg', 'FooterScan'),
('wave', 0, 508, 'wav', 'InternalSize'), ('avi', 0, 508, 'avi', 'InternalSize'), ('chunks', 0, 157, 'png', 'InternalSize'), ('end record', 0, 529, 'docx', 'InternalSize')) v(image, "offset", size, extension, boundary_method)"""
)
def carve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to find a size, on small images made for it."""
    rows = []
    for name, (size, parts) in _CASES.items():
        content = bytearray(size)
        for at, part in parts:
            content[at : at + len(part) // 2] = bytes.fromhex(part)
        rows.append((name, content))
    images = spark.createDataFrame(rows, "image string, content binary")
    return carve.carve_column(images, "image", F.col("content"), carve.CarveOptions(aligned=False, min_size=100)).select("image", "offset", "size", "extension", "boundary_method")


@_query("SELECT DISTINCT carve_id, printf('%08d_%012x.%s', carve_id, byte_offset, coalesce(extension, 'bin')) AS name FROM carved_files WHERE byte_offset IS NOT NULL")
def carve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "carved_files").where("byte_offset IS NOT NULL")
    return c.select("carve_id", carve.carved_name(F.col("carve_id"), F.col("byte_offset"), F.coalesce("extension", F.lit("bin"))).alias("name")).distinct()


@_query(
    """WITH c AS (SELECT DISTINCT carve_id, coalesce(extension, 'unknown') AS extension, size,
  CASE lower(replace(replace(boundary_method, '_', ''), ' ', '')) WHEN 'internalsize' THEN 'InternalSize' WHEN 'footerscan' THEN 'FooterScan' WHEN 'nextheader' THEN 'NextHeader'
    WHEN 'maxsizecap' THEN 'MaxSizeCap' WHEN 'maxsize' THEN 'MaxSizeCap' ELSE 'unknown' END AS boundary_method FROM carved_files)
SELECT extension, boundary_method, count(*) AS files, sum(size)::BIGINT AS bytes FROM c GROUP BY 1, 2"""
)
def carve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.lower(F.regexp_replace("boundary_method", "[_ ]", ""))
    method = F.when(plain == "internalsize", "InternalSize").when(plain == "footerscan", "FooterScan").when(plain == "nextheader", "NextHeader").when(plain.isin("maxsizecap", "maxsize"), "MaxSizeCap").otherwise("unknown")
    c = table(spark, sf_dir, "carved_files").select("carve_id", F.coalesce("extension", F.lit("unknown")).alias("extension"), "size", method.alias("boundary_method")).distinct()
    return carve.carve_summary(c)


@_query("SELECT doc_id, ('0x' || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2))::BIGINT AS number FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 6)")
def little_endian_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four bytes from the third on, as a size field is read."""
    return _images(spark, sf_dir).where(F.octet_length("content") >= 6).select("doc_id", little_endian(F.col("content"), 2).alias("number"))


# Manifests.
_PROOF = "WITH p AS (SELECT DISTINCT manifest_id, source_path, dest_path, size, lower(trim(blake3_hash)) AS h, verified FROM proof_entries) "


def _proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "proof_entries").select("manifest_id", "source_path", "dest_path", "size", diff.bare_hash(F.col("blake3_hash")).alias("h"), "verified").distinct()


@_query(_PROOF + "SELECT manifest_id, sha256(coalesce(string_agg(h, '' ORDER BY source_path, h), '')) AS root_hash FROM p GROUP BY 1")
def root_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.root_hashes(_proof(spark, sf_dir), "manifest_id", "source_path", "h")


@_query(_PROOF + "SELECT manifest_id, count(*) AS total_files, sum(coalesce(size, 0))::BIGINT AS total_bytes, count(*) FILTER (WHERE verified) AS verified_files FROM p GROUP BY 1")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.totals(_proof(spark, sf_dir), "manifest_id")


@_query(
    _PROOF
    + r""", e AS (SELECT *, upper(regexp_extract(regexp_extract(source_path, '([^/\\]*)$', 1), '^.+\.([^.]*)$', 1)) AS x FROM p)
SELECT manifest_id, CASE WHEN x = '' THEN 'UNKNOWN' ELSE x END AS type, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes FROM e GROUP BY 1, 2"""
)
def manifest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.by_extension(_proof(spark, sf_dir), "manifest_id", "source_path")


_STATUS = (
    _PROOF
    + r""", d AS (SELECT manifest_id, replace(dest_path, '\', '/') AS dest_path, arg_max(struct_pack(s := size, h := lower(trim(blake3_hash))), scanned_at) AS r FROM dest_entries GROUP BY 1, 2),
v AS (SELECT p.manifest_id, p.dest_path, CASE WHEN d.dest_path IS NULL THEN 'Missing' WHEN p.size IS DISTINCT FROM d.r.s THEN 'SizeChanged' WHEN p.h IS DISTINCT FROM d.r.h THEN 'HashMismatch' ELSE 'Ok' END AS status
  FROM p LEFT JOIN d ON p.manifest_id = d.manifest_id AND p.dest_path = d.dest_path) """
)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dest_entries").select("manifest_id", diff.slashes(F.col("dest_path")).alias("dest_path"), "scanned_at", "size", diff.bare_hash(F.col("blake3_hash")).alias("h"))
    newest = d.groupBy("manifest_id", "dest_path").agg(F.max(F.struct("scanned_at", "size", "h")).alias("r")).select("manifest_id", "dest_path", "r.size", "r.h")
    return proof.verified(_proof(spark, sf_dir), newest, ["manifest_id", "dest_path"], "size", "h")


@_query(_STATUS + "SELECT * FROM v")
def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@_query(
    _STATUS
    + """SELECT manifest_id, count(*) AS total, count(*) FILTER (WHERE status = 'Ok') AS verified, count(*) FILTER (WHERE status IN ('SizeChanged', 'HashMismatch')) AS failed,
count(*) FILTER (WHERE status = 'Missing') AS missing, count(*) FILTER (WHERE status <> 'Ok') = 0 AS clean FROM v GROUP BY 1"""
)
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.verify_counts(_status(spark, sf_dir), "manifest_id")


@_query(r"SELECT DISTINCT file_id, '/out/' || regexp_replace(path, '^(?:[A-Za-z]:)?[/\\]+', '') AS dest_path FROM files")
def export_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("file_id", proof.destination(F.col("path"), "/out/").alias("dest_path")).distinct()


@_query(r"SELECT '/out/' || regexp_extract(path, '([^/\\]*)$', 1) AS dest_path, count(*) AS files FROM (SELECT DISTINCT file_id, path FROM files) GROUP BY 1 HAVING count(*) > 1")
def export_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.collisions(table(spark, sf_dir, "files").select("file_id", "path").distinct(), "path", "/out")


# Blocks: a file per order, a block per line number, bad where anything was returned.
_BLOCKS = "WITH b AS (SELECT l_orderkey AS file, l_linenumber - 1 AS block, max(l_quantity)::BIGINT AS bytes, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1, 2) "
_MAPS = (
    _BLOCKS
    + """, m AS (SELECT file, count(*) AS total_blocks, count(*) FILTER (WHERE bad) AS bad_blocks, sum(CASE WHEN NOT bad THEN bytes ELSE 0 END)::BIGINT AS good_bytes, sum(CASE WHEN bad THEN bytes ELSE 0 END)::BIGINT AS bad_bytes FROM b GROUP BY 1) """
)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).alias("block")).agg(F.max("l_quantity").cast("long").alias("bytes"), F.max(F.col("l_returnflag") == "R").alias("bad"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.sector_maps(_blocks(spark, sf_dir), "file", "block", "bytes", "bad")


@_query(_MAPS + "SELECT *, round(CASE WHEN good_bytes + bad_bytes = 0 THEN 100.0 ELSE good_bytes * 100.0 / (good_bytes + bad_bytes) END, 4)::DOUBLE AS readable FROM m")
def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).withColumn("readable", F.round("readable", 4))


@_query(_BLOCKS + ", e AS (SELECT file, max(block) + 1 AS n FROM b GROUP BY 1) SELECT file, floor(block / greatest(ceil(n / 3.0), 1))::INT AS cell, bool_or(bad) AS bad FROM b JOIN e USING (file) GROUP BY 1, 2")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.heatmap(_blocks(spark, sf_dir), "file", "block", "bad", 3)


@_query(_MAPS + "SELECT count(*) AS files_scanned, count(*) FILTER (WHERE bad_blocks > 0) AS files_with_bad_sectors, sum(bad_blocks)::BIGINT AS total_bad_blocks, sum(bad_bytes)::BIGINT AS total_bad_bytes FROM m")
def bad_sector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.bad_report(_maps(spark, sf_dir))


# Logs: events as those of a session per user.
_KINDS = "CASE event_type WHEN 'click' THEN 'FileCompleted' WHEN 'error' THEN 'FileFailed' WHEN 'purchase' THEN 'Completed' ELSE event_type END"


@_query(
    f"""WITH e AS (SELECT user_id, ts, {_KINDS} AS kind FROM events)
SELECT user_id, count(*) FILTER (WHERE kind = 'FileCompleted') AS files_done, count(*) FILTER (WHERE kind = 'FileFailed') AS files_failed,
epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us, CASE WHEN arg_max(kind, struct_pack(t := ts, k := kind)) = 'Completed' THEN 'Completed' ELSE 'Running' END AS status FROM e GROUP BY 1"""
)
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_KINDS).alias("kind"))
    s = state.session_states(e, "user_id", "ts", "kind")
    return s.select("user_id", "files_done", "files_failed", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"), "status")


@_query("SELECT coalesce(status, 'unknown') AS result, count(*) AS entries FROM index_runs GROUP BY 1")
def heal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.log_summary(table(spark, sf_dir, "index_runs").select(F.coalesce("status", F.lit("unknown")).alias("result")), "result")


_REPAIRS = " ".join(f"WHEN regexp_matches(lower(error), '{'|'.join(parts)}') THEN '{name}'" for name, parts in texts.REPAIRS)
_ERRORS = "SELECT DISTINCT manifest_id, dest_path, bad_sector_notes AS error FROM proof_entries WHERE bad_sector_notes IS NOT NULL"


@_query(
    f"""WITH e AS ({_ERRORS}), a AS (SELECT *, unnest(range(3)) AS attempt FROM e)
SELECT dest_path, attempt::INT AS attempt, least(100 * pow(2, attempt), 5000)::BIGINT AS delay_ms,
CASE {_REPAIRS} ELSE 'generic' END AS repair FROM a
WHERE NOT regexp_matches(lower(error), 'permission denied|access denied|file not found|no such file|directory not found|invalid path')"""
)
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "proof_entries").where("bad_sector_notes IS NOT NULL").select("manifest_id", "dest_path", F.col("bad_sector_notes").alias("error")).distinct()
    return state.retry_schedule(failures, "dest_path", "error")


@_query("SELECT source_root, arg_max(run_id, struct_pack(s := started_at, r := run_id)) AS run_id FROM index_runs WHERE coalesce(status, '') <> 'completed' GROUP BY 1")
def resumable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.resumable(table(spark, sf_dir, "index_runs"), "source_root", "run_id", "started_at", "status")


@_query("SELECT run_id, source_root FROM (SELECT *, row_number() OVER (PARTITION BY source_root ORDER BY started_at DESC, run_id DESC) AS n FROM index_runs WHERE status = 'completed') WHERE n > 3")
def expired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "index_runs").where("status = 'completed'")
    return state.beyond_newest(done, "source_root", "run_id", "started_at", 3).select("run_id", "source_root")
