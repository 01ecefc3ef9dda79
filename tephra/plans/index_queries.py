"""Index, search and duplicate queries over the files table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, names, texts
from ..operators import dedup, search
from ..runtime import table


def index(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The file index: one row per file, only the columns asked for, with what its path says."""
    return search.entries(table(spark, sf_dir, "files").select("file_id", "path", *columns).distinct())


_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '^.+\.([^.]*)$', 1))"
_F = rf"""
WITH f AS (
  SELECT *, regexp_extract(path, '([^/\\]*)$', 1) AS name, {_EXT} AS ext, {names.sql_lookup(_EXT, names.FILE_TYPES, 'Other')} AS kind,
    {names.sql_lookup(_EXT, names.MEDIA_TYPES, 'unknown')} AS media
  FROM (SELECT DISTINCT file_id, path, size, modified, has_bad_sectors, hash FROM files))
"""
_TEMP = r"regexp_matches(lower(name), '~$|\.bak$|\.tmp$|\.swp$|\.orig$|_old|_backup|_copy| - copy|\(1\)|\(2\)|\(3\)|^~\$')"

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(_F + "SELECT file_id, name, ext, kind, media FROM f")
def files_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("file_id", "name", "ext", "kind", "media")


@_query(_F + f"SELECT ext, {names.sql_lookup('ext', names.LANGUAGES, 'unknown')} AS language, count(*) AS files FROM f WHERE kind = 'Code' GROUP BY 1, 2")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).where("kind = 'Code'").groupBy("ext", names.language(F.col("ext")).alias("language")).agg(F.count("*").alias("files"))


@_query(_F + "SELECT kind, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes FROM f GROUP BY 1")
def file_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(index(spark, sf_dir, "size"))


@_query(_F + "SELECT media, count(*) AS files FROM f GROUP BY 1")
def media_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).groupBy("media").agg(F.count("*").alias("files"))


@_query(_F + "SELECT CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind END AS kind, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes, count(*) FILTER (WHERE has_bad_sectors) AS bad_files FROM f GROUP BY ROLLUP (kind)")
def stats_by_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.statistics(index(spark, sf_dir, "size", "has_bad_sectors"))


@_query(
    _F
    + """, k AS (SELECT kind, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes FROM f GROUP BY 1)
SELECT kind, files, bytes, floor(100 * files / sum(files) OVER ())::BIGINT AS percent, floor(40 * files / max(files) OVER ())::BIGINT AS bar FROM k"""
)
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.distribution(index(spark, sf_dir, "size"))


@_query(_F + "SELECT kind, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes FROM f GROUP BY 1 ORDER BY files DESC, kind LIMIT 6")
def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_kinds(index(spark, sf_dir, "size"))


@_query(_F + "SELECT file_id, path FROM f WHERE kind = 'Image'")
def search_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_type(index(spark, sf_dir), "photos").select("file_id", "path")


@_query(_F + "SELECT file_id, path FROM f WHERE name GLOB '*_20[123]?*.pdf'")
def search_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.glob(index(spark, sf_dir), "*_20[123]?*.pdf").select("file_id", "path")


@_query(_F + r"SELECT file_id, path FROM f WHERE regexp_matches(name, '^.*(draft|final).*\.(jpg|png|pdf)$')")
def search_glob_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.glob(index(spark, sf_dir), "*{draft,final}*.{jpg,png,pdf}").select("file_id", "path")


@_query(_F + r"SELECT file_id, path FROM f WHERE regexp_matches(path, '/(photos|media)/.*\.(jpe?g|png)$')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex(index(spark, sf_dir), r"/(photos|media)/.*\.(jpe?g|png)$").select("file_id", "path")


@_query(_F + "SELECT file_id, path FROM f WHERE contains(lower(name), 'copy')")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(index(spark, sf_dir), "COPY").select("file_id", "path")


@_query(_F + "SELECT file_id, path FROM f WHERE regexp_matches(lower(name), 'z.*b.*p.*d.*f')")
def search_fuzzy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.subsequence(index(spark, sf_dir), "zbpdf").select("file_id", "path")


@_query(None)
def search_fuzzy_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the hundred best by score."""
    return search.subsequence(index(spark, sf_dir), "zbpdf").orderBy(F.desc("score"), "path").select("file_id", "path", "score").limit(100)


@_query(
    _F
    + """SELECT file_id, path FROM f WHERE contains(lower(name), 'ma') AND kind = 'Document' AND size >= 10240 AND size <= 10485760
AND (modified IS NULL OR modified >= TIMESTAMPTZ '2030-01-01 00:00:00+00') AND (modified IS NULL OR modified <= TIMESTAMPTZ '2031-06-30 23:59:59+00') ORDER BY path LIMIT 100"""
)
def search_filters_null_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(index(spark, sf_dir, "size", "modified"), "ma", "exact", "docs", 10240, 10485760, "2030-01-01", "2031-06-30").select("file_id", "path")


@_query(_F + r"SELECT file_id, path FROM f WHERE ext IN ('jpg', 'rs') AND NOT regexp_matches(path, '(^|[/\\])\.')  AND len(regexp_split_to_array(regexp_replace(path, '^[/\\]+', ''), '[/\\]+')) <= 5")
def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan_filter(index(spark, sf_dir), F.lit(""), [".JPG", "rs"], max_depth=5).select("file_id", "path")


@_query(_F + f"SELECT file_id, {_TEMP} AS temp FROM f")
def temp_name_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("file_id", names.is_temp_name(F.col("path")).alias("temp"))


@_query(
    _F
    + "SELECT file_id, ext IN (" + ", ".join(repr(e) for e in names.DISK_IMAGES.split()) + ") AS disk_image, ext IN (" + ", ".join(repr(e) for e in names.PREVIEWABLE.split()) + ") AS previewable, coalesce(has_bad_sectors, false) AS unreadable FROM f"
)
def kind_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = index(spark, sf_dir, "has_bad_sectors")
    return f.select("file_id", F.col("ext").isin(names.DISK_IMAGES.split()).alias("disk_image"), F.col("ext").isin(names.PREVIEWABLE.split()).alias("previewable"), F.coalesce("has_bad_sectors", F.lit(False)).alias("unreadable"))


def _nested(expression: str, value: str) -> str:
    for mark in names.STRIPPED:
        expression = f"replace({expression}, '{mark}', '')"
    for pattern in names.STRIPPED_PATTERNS:
        expression = f"regexp_replace({expression}, '{pattern}', '', 'g')"
    return f"{value} lower(trim({expression})) AS cleaned"


_NORM = (
    _F
    + r", s AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem FROM f), "
    + f"n AS (SELECT *, {_nested('nfc_normalize(stem)', '')} FROM s), "
    + "m AS (SELECT *, CASE WHEN cleaned = '' THEN lower(stem) ELSE cleaned END || '.' || ext AS norm FROM n) "
)


@_query(_NORM + "SELECT file_id, norm FROM m")
def normalize_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("file_id", names.normalised_name(F.col("path")).alias("norm"))


@_query(_NORM + "SELECT norm, count(*) AS files, sum(size)::BIGINT AS bytes FROM m WHERE size >= 1 GROUP BY norm HAVING count(*) > 1")
def fuzzy_norm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = index(spark, sf_dir, "size").where("size >= 1")
    return f.groupBy(names.normalised_name(F.col("path")).alias("norm")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).where("files > 1")


# Paths of the older duplicate report serve as a selection.
def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dup_groups").select(F.explode("duplicates").alias("path"))


_SEL = ", sel AS (SELECT DISTINCT unnest(duplicates) AS path FROM dup_groups) "


@_query(_F + _SEL + "SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM f WHERE path IN (SELECT path FROM sel)")
def select_semi_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.selected_bytes(index(spark, sf_dir, "size"), _selection(spark, sf_dir))


@_query(_F + _SEL + "SELECT file_id, path FROM f WHERE path NOT IN (SELECT path FROM sel WHERE path IS NOT NULL)")
def invert_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inverted(index(spark, sf_dir), _selection(spark, sf_dir)).select("file_id", "path")


@_query(_F + _SEL + "SELECT kind, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes FROM f WHERE path IN (SELECT path FROM sel) GROUP BY 1")
def summarize_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(index(spark, sf_dir, "size"), _selection(spark, sf_dir))


@_query("SELECT DISTINCT path FROM (SELECT master AS path FROM dup_groups WHERE master IS NOT NULL UNION ALL SELECT unnest(duplicates) FROM dup_groups UNION ALL SELECT source_path FROM proof_entries) WHERE path IS NOT NULL")
def union_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    masters = table(spark, sf_dir, "dup_groups").select(F.col("master").alias("path"))
    exported = table(spark, sf_dir, "proof_entries").select(F.col("source_path").alias("path"))
    return search.united(masters, _selection(spark, sf_dir), exported).where("path IS NOT NULL")


@_query(
    """SELECT path, arg_max(run_id, struct_pack(a := marked_at, b := run_id)) AS run_id, epoch_us(max(marked_at)) AS marked_us FROM checkpoint_entries GROUP BY path"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(table(spark, sf_dir, "checkpoint_entries").select("path", "run_id", "marked_at"), "path", ["marked_at", "run_id"]).select("path", "run_id", F.unix_micros("marked_at").alias("marked_us"))


@_query(_F + "SELECT file_id, path FROM f WHERE path NOT IN (SELECT path FROM checkpoint_entries WHERE path IS NOT NULL)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inverted(index(spark, sf_dir), table(spark, sf_dir, "checkpoint_entries")).select("file_id", "path")


@_query(_F + "SELECT path, name AS label, len([p for p in string_split(replace(path, '\\', '/'), '/') if p <> '']) AS depth FROM f")
def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tree(index(spark, sf_dir))


@_query(_F + "SELECT file_id, path FROM f ORDER BY path LIMIT 50 OFFSET 100")
def index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(index(spark, sf_dir), 2).select("file_id", "path")


@_query(_F + "SELECT file_id, substr(sha256(path), 1, 16) AS key FROM f")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("file_id", digests.path_key(F.col("path")).alias("key"))


_SCORES = {
    "newest": f"coalesce(floor(epoch(modified))::BIGINT, 0) + (NOT {_TEMP})::BIGINT",
    "largest": f"size + (NOT {_TEMP})::BIGINT",
    "oldest": f"coalesce(-floor(epoch(modified))::BIGINT, -4611686018427387904) + (NOT {_TEMP})::BIGINT",
    "cleanest": f"(NOT {_TEMP})::BIGINT * 1000 + coalesce(trunc(floor(epoch(modified)) / 1000000)::BIGINT, 0)",
}


def _exact(keep: str) -> str:
    return (
        _F
        + f""", h AS (SELECT size, lower(trim(hash)) AS hash, path, {_SCORES[keep]} AS score FROM f WHERE size >= 1 AND hash IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY size, hash) AS files, row_number() OVER (PARTITION BY size, hash ORDER BY score DESC, path) AS rn FROM h),
g AS (SELECT hash, size, files, size * (files - 1) AS wasted_bytes, path AS master FROM r WHERE rn = 1 AND files > 1) """
    )


def _groups(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    return dedup.exact_groups(index(spark, sf_dir, "size", "hash", "modified"), keep)


for _keep in dedup.KEEP:
    QUERIES[f"dedup_exact_{_keep}"] = lambda s, d, k=_keep: _groups(s, d, k)
    SQL[f"dedup_exact_{_keep}"] = _exact(_keep) + "SELECT * FROM g"


@_query(
    _exact("newest")
    + """SELECT (SELECT count(*) FROM f) AS scanned_files, count(*) AS duplicate_groups, sum(files - 1)::BIGINT AS total_duplicates, sum(wasted_bytes)::BIGINT AS wasted_bytes,
(SELECT count(*) FROM f) - sum(files - 1)::BIGINT AS unique_files FROM g"""
)
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(index(spark, sf_dir), _groups(spark, sf_dir, "newest"))


@_query(_exact("newest") + "SELECT h.path, h.size FROM h JOIN g USING (size, hash) WHERE h.path <> g.master")
def dedup_purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.purge_plan(index(spark, sf_dir, "size", "hash"), _groups(spark, sf_dir, "newest"))


@_query(_exact("cleanest") + "SELECT h.hash, h.size, h.path, CASE WHEN h.path = g.master THEN 'master' ELSE 'duplicate' END AS role FROM h JOIN g USING (size, hash)")
def dedup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_members(index(spark, sf_dir, "size", "hash"), _groups(spark, sf_dir, "cleanest"))


@_query(None)
def dedup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by name and size of the files that are in no exact group."""
    f = index(spark, sf_dir, "size", "hash", "modified")
    members = dedup.exact_members(f, _groups(spark, sf_dir, "newest"))
    return dedup.fuzzy_groups(f, exclude=members)


@_query(
    _F
    + """, g AS (SELECT name, kind, size FROM f) SELECT kind, CASE WHEN size IS NULL THEN 'unknown' WHEN size < 1024 THEN size::VARCHAR || ' B' ELSE 'more' END AS label, count(*) AS files FROM g GROUP BY 1, 2"""
)
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("size").isNull(), "unknown").when(F.col("size") < 1024, texts.size_text(F.col("size"))).otherwise("more")
    return index(spark, sf_dir, "size").groupBy("kind", label.alias("label")).agg(F.count("*").alias("files"))


@_query(None)
def size_labels_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every size labelled in its unit, B to PiB; ``size_labels`` is held by its SQL to those under 1 KiB."""
    label = F.when(F.col("size").isNull(), "unknown").otherwise(texts.size_text(F.col("size")))
    return index(spark, sf_dir, "size").groupBy("kind", label.alias("label")).agg(F.count("*").alias("files"))
