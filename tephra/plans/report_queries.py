"""Totals, ordered reports, scalars over all rows and literal cases, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import digests, pictures, texts, vectors
from ..operators import dedup, search, sectors, state, text_search, totals
from ..runtime import table
from . import index_queries, record_queries, text_queries

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_F = index_queries._F


@_query(_F + "SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, count(*) FILTER (size IS NULL) AS unread FROM f")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.scan_totals(index_queries.index(spark, sf_dir, "size"))


@_query(
    """WITH p AS (SELECT DISTINCT * FROM proof_entries),
s AS (SELECT manifest_id, count(*) FILTER (coalesce(verified, false)) AS exported, count(*) FILTER (NOT coalesce(verified, false)) AS failed, coalesce(sum(size), 0)::BIGINT AS bytes,
  coalesce((epoch_us(max(exported_at)) - epoch_us(min(exported_at))) // 1000, 0) AS duration_ms FROM p GROUP BY 1)
SELECT *, CASE WHEN duration_ms > 0 THEN bytes::HUGEINT * 1000 // duration_ms ELSE 0 END::BIGINT AS bytes_per_second FROM s"""
)
def export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.export_totals(table(spark, sf_dir, "proof_entries").distinct(), "manifest_id")


@_query(
    text_queries._TOKENS
    + """SELECT 1 AS number, 'scanned' AS stage, (SELECT count(DISTINCT file_id) FROM files) AS rows
UNION ALL SELECT 2, 'read', (SELECT count(*) FROM documents WHERE text <> '')
UNION ALL SELECT 3, 'indexed', (SELECT count(DISTINCT doc_id) FROM tok)"""
)
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return totals.pipeline_summary(scanned=table(spark, sf_dir, "files").select("file_id").distinct(), read=docs.where("text <> ''"), indexed=text_search.postings(docs, "doc_id", "text").select("doc_id").distinct())


@_query('SELECT doc_id, "offset", signature, row_number() OVER (PARTITION BY doc_id ORDER BY "offset")::INT AS n FROM (' + record_queries.SQL["carve_hits"] + ")")
def carve_hits_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header hits numbered by offset within their image."""
    hits = record_queries.carve_hits(spark, sf_dir)
    return hits.select("doc_id", "offset", "signature", F.row_number().over(Window.partitionBy("doc_id").orderBy("offset")).alias("n"))


@_query("SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY files DESC, type)::INT AS place FROM (" + record_queries.SQL["manifest_types"] + ")")
def manifest_types_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each manifest, the most frequent first."""
    types = record_queries.manifest_types(spark, sf_dir)
    return types.withColumn("place", F.row_number().over(Window.partitionBy("manifest_id").orderBy(F.desc("files"), "type"))).orderBy("manifest_id", "place")


_NORM = index_queries.SQL["normalize_name_keys"]


def _fuzzy_sql(select: str) -> str:
    """Greedy clusters of the files in no exact group, one step per place within a name."""
    return (
        index_queries._exact("newest").replace("WITH f AS", "WITH RECURSIVE f AS", 1)
        + f""", ex AS (SELECT DISTINCT h.path FROM h JOIN g USING (size, hash)),
nk AS ({_NORM}),
o AS (SELECT nk.norm, f.path, f.size, {index_queries._SCORES["newest"]} AS score, row_number() OVER (PARTITION BY nk.norm ORDER BY f.path) AS n
  FROM f JOIN nk ON nk.file_id = f.file_id WHERE f.size >= 1 AND f.path NOT IN (SELECT path FROM ex)),
w AS (
  SELECT norm, n, path, size, score, 0 AS cluster, size AS reference, [size] AS firsts FROM o WHERE n = 1
  UNION ALL
  SELECT norm, n, path, size, score, coalesce(hit, len(firsts)::INT + 1) - 1, CASE WHEN hit IS NULL THEN size ELSE firsts[hit] END, CASE WHEN hit IS NULL THEN list_append(firsts, size) ELSE firsts END
  FROM (SELECT o.*, w.firsts, nullif(list_position([CASE WHEN o.size * 100 // x <= 100 THEN o.size * 100 // x ELSE greatest(0, 200 - least(o.size * 100 // x, 255)) END >= 85 for x in w.firsts], true), 0) AS hit
    FROM w JOIN o ON o.norm = w.norm AND o.n = w.n + 1)),
m AS (SELECT *, CASE WHEN size * 100.0::DOUBLE / reference <= 100 THEN size * 100.0::DOUBLE / reference ELSE 200 - size * 100.0::DOUBLE / reference END AS near,
  row_number() OVER (PARTITION BY norm, cluster ORDER BY score DESC, path) AS rn, count(*) OVER (PARTITION BY norm, cluster) AS files FROM w),
z AS (SELECT norm, cluster::INT AS cluster, any_value(files) AS files, floor(avg(near))::INT AS similarity, (sum(size) - max(CASE WHEN rn = 1 THEN size END))::BIGINT AS wasted_bytes,
  max(CASE WHEN rn = 1 THEN path END) AS master FROM m WHERE files > 1 GROUP BY 1, 2) """
        + select
    )


SQL["dedup_fuzzy"] = _fuzzy_sql("SELECT * FROM z")
QUERIES["dedup_fuzzy"] = index_queries.dedup_fuzzy


@_query(
    _fuzzy_sql(
        """SELECT 'exact' AS kind, hash AS name, 100 AS similarity, files, wasted_bytes, master FROM g
UNION ALL SELECT 'fuzzy', norm || '#' || cluster, similarity, files, wasted_bytes, master FROM z"""
    )
)
def dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and fuzzy groups together."""
    return dedup.all_groups(index_queries._groups(spark, sf_dir, "newest"), index_queries.dedup_fuzzy(spark, sf_dir))


def _unit(power: int, unit: str) -> str:
    hundredths = f"((size::HUGEINT * 200 + {1024**power}) // {2 * 1024**power})"
    return f"{hundredths} // 100 || '.' || lpad(({hundredths} % 100)::VARCHAR, 2, '0') || ' {unit}'"


SQL["size_labels_whole"] = (
    _F
    + f"""SELECT kind, CASE WHEN size IS NULL THEN 'unknown' WHEN size < 1024 THEN size || ' B' WHEN size < {1 << 20} THEN {_unit(1, "KiB")} WHEN size < {1 << 30} THEN {_unit(2, "MiB")}
  WHEN size < {1 << 40} THEN {_unit(3, "GiB")} WHEN size < {1 << 50} THEN {_unit(4, "TiB")} ELSE {_unit(5, "PiB")} END AS label, count(*) AS files FROM f GROUP BY 1, 2"""
)
QUERIES["size_labels_whole"] = index_queries.size_labels_whole


@_query(_F + "SELECT path, size FROM f ORDER BY path LIMIT 100")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_by_path(index_queries.index(spark, sf_dir, "size").select("path", "size"))


@_query(_F + ", o AS (SELECT path, (row_number() OVER (ORDER BY path) - 1)::INT AS n FROM f), s AS (SELECT max(path) AS path FROM (SELECT path FROM o ORDER BY path LIMIT 61)) SELECT path, n FROM o WHERE n >= 50 AND n < 70")
def scroll_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a screen of 20 around the 61st path."""
    rows = index_queries.index(spark, sf_dir).select("path")
    selected = rows.orderBy("path").offset(60).limit(1).first()
    return search.around(rows, "path", selected[0] if selected else "", 20)


@_query(_F + "SELECT kind, sum((size + 4095) // 4096)::BIGINT AS blocks, max((size + 511) // 512) AS most_sectors FROM f WHERE size IS NOT NULL GROUP BY 1")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = index_queries.index(spark, sf_dir, "size").where("size IS NOT NULL")
    return files.groupBy("kind").agg(F.sum(texts.block_count(F.col("size"))).alias("blocks"), F.max(texts.block_count(F.col("size"), 512)).alias("most_sectors"))


@_query("SELECT DISTINCT run_id, strftime(started_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') AS started, strftime(started_at AT TIME ZONE 'UTC', 'DD-%Y%m%d-%H%M') AS case_number FROM index_runs WHERE started_at IS NOT NULL")
def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_runs").where("started_at IS NOT NULL").select("run_id", texts.utc_text(F.col("started_at")).alias("started"), texts.case_number(F.col("started_at")).alias("case_number")).distinct()


_BYTES = """WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, h, printf('%016X', length(h) // 2) AS n FROM d) """
_LE64 = "||".join(f"substr(n, {15 - 2 * i}, 2)" for i in range(8))


@_query(_BYTES + f"SELECT doc_id, CASE WHEN length(h) // 2 > 512 THEN sha256(unhex({_LE64} || substr(h, 1, 512) || substr(h, length(h) - 511, 512))) ELSE sha256(unhex(h)) END AS digest FROM s")
def partial_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of size, first and last 256 bytes of texts over 512 bytes, of the whole of others."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", digests.partial_hash(F.col("text").cast("binary"), 256).alias("digest"))


_DIMS = 8


@_query(
    f"""WITH v AS (SELECT doc_id, [('0x' || substr(sha256(text), 2 * (i % 32) + 1, 2))::INT / 255.0::DOUBLE * 2.0 - 1.0 for i in range({_DIMS})] AS v FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, v, sqrt(list_sum([x * x for x in v])) AS norm FROM v)
SELECT doc_id, """
    + ", ".join(f"round(v[{i + 1}] / norm, 6) AS v{i}" for i in range(_DIMS))
    + " FROM n"
)
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of unit length, coordinate by coordinate."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", vectors.hash_embedding(F.col("text"), _DIMS).alias("v"))
    return rows.select("doc_id", *(F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(_DIMS)))


_SIZES = ["10", "10B", "2kb", " 3 MB ", "4GB", "5TB", "1.5MB", "", "x", "-1KB", "7 kb", "99999999999999999999"]


@_query(
    "WITH t AS (SELECT unnest(["
    + ", ".join(f"'{s}'" for s in _SIZES)
    + r"""]) AS given), p AS (SELECT given, regexp_extract(upper(trim(given)), '^(\d+)\s*(B|KB|MB|GB)?$', 1) AS n, regexp_extract(upper(trim(given)), '^(\d+)\s*(B|KB|MB|GB)?$', 2) AS u FROM t)
SELECT given, coalesce(try_cast(n AS BIGINT) * CASE u WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END, -1)::BIGINT AS bytes FROM p"""
)
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of size texts; -1 where there is no size."""
    rows = spark.createDataFrame([(s,) for s in _SIZES], "given string")
    return rows.select("given", F.coalesce(texts.parsed_size(F.col("given")), F.lit(-1)).alias("bytes"))


_SECONDS = [0.0, 0.25, 0.999, 1.0, 30.0, 59.5, 60.0, 90.0, 3599.0, 3600.0, 3700.0, 86399.0, 86400.0, 200000.0]


@_query(
    "WITH t AS (SELECT unnest(["
    + ", ".join(map(str, _SECONDS))
    + """]::DOUBLE[]) AS s), w AS (SELECT s, floor(s)::BIGINT AS i FROM t)
SELECT s AS seconds, CASE WHEN s < 1 THEN floor(s * 1000)::BIGINT || 'ms' WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN (i // 60) || 'm ' || (i % 60) || 's'
  ELSE (i // 3600) || 'h ' || (i % 3600 // 60) || 'm ' || (i % 60) || 's' END AS duration,
CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (i // 60) || ' min ago' WHEN s < 86400 THEN (i // 3600) || ' hours ago' ELSE (i // 86400) || ' days ago' END AS age,
round(1.0::DOUBLE + 0.1::DOUBLE / (1.0::DOUBLE + floor(s / 3600) / 24.0::DOUBLE), 9) AS recency, CASE WHEN s > 0 THEN round((1000000 - s) * 5.0::DOUBLE / s, 6) ELSE -1 END AS remaining FROM w"""
)
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, ages, recency factors and times that remain."""
    s = F.col("seconds")
    rows = spark.createDataFrame([(x,) for x in _SECONDS], "seconds double")
    left = texts.remaining_seconds(s, F.lit(1_000_000.0), F.lit(5.0))
    return rows.select(s, texts.duration_text(s).alias("duration"), texts.age_text(s).alias("age"), F.round(texts.recency_factor(s / 3600), 9).alias("recency"), F.coalesce(F.round(left, 6), F.lit(-1.0)).alias("remaining"))


@_query(
    """WITH p AS (SELECT DISTINCT a.file_id, a.size, b.size AS reference FROM dup_groups g, unnest(g.duplicates) u(path), files a, files b WHERE a.path = u.path AND b.path = g.master AND a.size > 0 AND b.size > 0)
SELECT file_id, size, reference, CASE WHEN size * 100 // reference <= 100 THEN size * 100 // reference ELSE greatest(0, 200 - least(size * 100 // reference, 255)) END::INT AS similarity FROM p"""
)
def size_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near in size the duplicates of older reports are to their masters."""
    files = table(spark, sf_dir, "files").where("size > 0").select("file_id", "path", "size").distinct()
    pairs = table(spark, sf_dir, "dup_groups").select("master", F.explode("duplicates").alias("path"))
    masters = files.select(F.col("path").alias("master"), F.col("size").alias("reference"))
    met = pairs.join(files, "path").join(masters, "master").select("file_id", "size", "reference").distinct()
    return met.withColumn("similarity", texts.size_similarity(F.col("size"), F.col("reference")))


@_query("SELECT doc_id, length(text) AS characters FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents UNION SELECT max(doc_id) FROM documents)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents by their keys, which reach the scan as filters."""
    docs = table(spark, sf_dir, "documents")
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return docs.where(F.col("doc_id").isin([x for x in ends if x is not None])).select("doc_id", F.length("text").cast("long").alias("characters"))


@_query(
    """WITH b AS (SELECT doc_id, unnest(range(0, greatest((strlen(text) + 4095) // 4096, 1))) AS block, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
bad AS (SELECT doc_id, block FROM b WHERE (doc_id + block) % 5 = 0)
SELECT doc_id, count(*) AS blocks, count(*) FILTER ((doc_id + block) % 5 = 0 AND n > 0) AS bad_blocks,
  coalesce(sum(CASE WHEN (doc_id + block) % 5 = 0 THEN least(4096, n - block * 4096) END), 0)::BIGINT AS zero_bytes FROM b GROUP BY 1"""
)
def zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in blocks of which some can't be read and are filled with zeros: what comes out, counted."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("content"))
    n = F.octet_length("content")
    blocks = docs.select("doc_id", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n + 4095) / 4096) - 1, F.lit(0)).cast("int"))).alias("block"))
    blocks = blocks.select("doc_id", "block", F.substring("content", F.col("block") * 4096 + 1, F.lit(4096)).alias("content"))
    bad = blocks.where("(doc_id + block) % 5 = 0").select("doc_id", "block")
    filled = sectors.zero_filled(blocks, bad, "doc_id", "block", "content")
    zero = F.hex("content").rlike("^(00)+$")
    return filled.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(zero).alias("bad_blocks"), F.coalesce(F.sum(F.when(zero, F.octet_length("content"))), F.lit(0)).cast("long").alias("zero_bytes"))


@_query("SELECT o AS orientation, w AS width, h AS height FROM (VALUES (1, 40, 30), (2, 40, 30), (3, 40, 30), (4, 40, 30), (5, 30, 40), (6, 30, 40), (7, 30, 40), (8, 30, 40)) v(o, w, h)")
def upright_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of 40 by 30 in each orientation."""
    return spark.createDataFrame([(o, *pictures.upright_size(40, 30, o)) for o in range(1, 9)], "orientation int, width int, height int")


@_query(text_queries._TOKENS + "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT term) FROM tok) AS terms, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, different terms and vectors of a search index."""
    docs = table(spark, sf_dir, "documents")
    return text_search.index_statistics(docs, "doc_id", "text", F.when(F.col("text").isNotNull(), vectors.hash_embedding(F.col("text"), 8)).otherwise(F.array().cast("array<double>")))


_RUNS = "FROM (SELECT DISTINCT run_id, status FROM index_runs WHERE status IN ('failed', 'crashed'))"


@_query(
    f"""SELECT result, retries_left, count(*) AS entries FROM (
SELECT 'Healed' AS result, 2 AS retries_left {_RUNS} WHERE status = 'failed' AND run_id % 2 = 0
UNION ALL SELECT 'Skipped', 3 {_RUNS} WHERE status = 'failed' AND run_id % 2 = 1
UNION ALL SELECT CASE WHEN n < 3 THEN 'Retrying' ELSE 'Failed' END, CASE WHEN n < 3 THEN 2 - n ELSE 0 END FROM (SELECT run_id {_RUNS} WHERE status = 'crashed'), (SELECT unnest(range(4)) AS n)) GROUP BY 1, 2"""
)
def heal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs tried again: timeouts are mended, refused permissions skipped, refused connections stay; log entries counted."""
    runs = table(spark, sf_dir, "index_runs").where("status IN ('failed', 'crashed')").select("run_id", "status").distinct()
    error = F.when(F.col("status") == "crashed", "connection refused").when(F.col("run_id") % 2 == 0, "timed out").otherwise("Permission denied")
    failures = runs.select(F.lit("Scan").alias("agent"), F.col("run_id").cast("string").alias("source"), error.alias("error"), F.lit(3).alias("retries_left"))
    log = state.heal(failures, lambda agent, source, repair: None if repair == "timeout" else "connection refused", pause=lambda seconds: None)
    return log.groupBy("result", "retries_left").agg(F.count("*").alias("entries"))
