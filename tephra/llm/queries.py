"""Queries of the training-data problems, and their SQL."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .components import components
from .contamination import leaked
from .near_duplicates import near_groups, near_pairs
from .packing import pack
from .sentences import sentences
from .splitting import split_texts
from .survivors import Candidate, pick_columns, shared_vote, standing, survivors

P1_FIELDS = ["created", "modified", "thumbnail", "master"]


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group and files record behind its paths, with the trust rank of the source."""
    groups = table(spark, sf_dir, "dup_groups")
    paths = groups.select("group_id", F.explode(F.concat(F.array("master"), F.coalesce("duplicates", F.array().cast("array<string>")))).alias("path")).where("path IS NOT NULL").distinct()
    files = table(spark, sf_dir, "files")
    sources = table(spark, sf_dir, "sources").groupBy("source_root").agg(F.min("trust_rank").alias("trust_rank"))
    return paths.join(files, "path").join(sources, "source_root", "left")


def _survivors(copies: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The four fields that come from the best copy; with ``as_of`` also those that copies vote on by equal values."""
    c = {n: copies[n] for n in copies.columns}
    dated = lambda t: t.isNotNull() & (t >= F.lit("1980-01-01").cast("timestamp")) & (t <= c["indexed_at"])
    shown = c["thumbnail"].isNotNull() & ~F.lower(F.trim(c["thumbnail"])).isin("", "null", "n/a")
    usable = {"created": dated(c["created"]), "modified": dated(c["modified"]), "thumbnail": shown}
    known = sum((F.coalesce(u, F.lit(False)).cast("int") for u in usable.values()), F.lit(0))
    value = lambda f: F.unix_micros(c[f]) if f != "thumbnail" else c[f]
    best = [Candidate(f, value(f), u, standing(c["trust_rank"], c["indexed_at"])) for f, u in usable.items()]
    best.append(Candidate("master", c["path"], F.lit(True), standing(c["trust_rank"], c["indexed_at"], known)))
    if as_of is None:
        return survivors(copies, "group_id", "file_id", best)
    vote = shared_vote(c["trust_rank"], c["indexed_at"], F.lit(as_of).cast("timestamp"))
    voted = [
        Candidate("hash", F.lower(F.trim(c["hash"])), F.trim(c["hash"]) != "", vote, F.lower(F.trim(c["hash"]))),
        Candidate("size", c["size"], c["size"] > 0, vote, c["size"]),
        Candidate("extension", F.lower(F.trim(c["extension"])), F.trim(c["extension"]) != "", vote, F.lower(F.trim(c["extension"]))),
    ]
    return survivors(copies, "group_id", "file_id", best + voted)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _survivors(_copies(spark, sf_dir)).where("copies >= 2")
    return pick_columns(one, "group_id", P1_FIELDS).withColumnRenamed("record", "file_id")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group, with wasted_bytes as the bytes of all copies but the master's; 0 where no copy has a usable time or size."""
    copies = _copies(spark, sf_dir)
    as_of = table(spark, sf_dir, "files").agg(F.max("indexed_at")).first()[0]
    one = _survivors(copies, as_of or datetime(1970, 1, 1)).where("copies >= 2")
    bytes_ = copies.select("group_id", "file_id", "size").dropDuplicates(["group_id", "file_id"]).groupBy("group_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("all_bytes"))
    sizes = table(spark, sf_dir, "files").groupBy("file_id").agg(F.max(F.coalesce("size", F.lit(0))).alias("kept_bytes"))
    whole = one.join(bytes_, "group_id").join(sizes, F.col("master.record") == F.col("file_id"))
    return whole.select(
        "group_id",
        "copies",
        F.col("master.value").alias("master"),
        F.coalesce(F.col("created.value").cast("long"), F.lit(0)).alias("created_us"),
        F.coalesce(F.col("modified.value").cast("long"), F.lit(0)).alias("modified_us"),
        F.col("thumbnail.value").alias("thumbnail"),
        F.col("hash.value").alias("hash"),
        F.coalesce(F.col("size.value").cast("long"), F.lit(0)).alias("size"),
        F.col("extension.value").alias("extension"),
        (F.col("all_bytes") - F.col("kept_bytes")).alias("wasted_bytes"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "match_pairs").where("similarity >= 85")
    return components(linked, "master_id", "duplicate_id").select(F.col("node").alias("file_id"), F.col("component").alias("group_id"))


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each group of linked files has."""
    return p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("files"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    """Pieces of the documents by the settings of their source."""
    settings = table(spark, sf_dir, "swarm_configs").groupBy("source").agg(F.min_by(F.struct("chunk_size", F.coalesce("overlap", "chunk_overlap").alias("overlap"), "min_chunk_size"), "config_id").alias("set"))
    docs = table(spark, sf_dir, "documents").join(settings, "source", "left")
    return split_texts(docs, "doc_id", "text", F.coalesce("set.chunk_size", F.lit(1024)), F.coalesce("set.overlap", F.lit(128)), F.coalesce("set.min_chunk_size", F.lit(64)), with_text)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _pieces(spark, sf_dir, with_text=False)
    return cuts.groupBy("doc_id").agg(F.when(F.max(F.col("cut") == "character"), "forced").otherwise("natural").alias("cut"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves, with their texts."""
    return _pieces(spark, sf_dir, with_text=True)


NEAR_FILES = {"least": 0.75, "size_ratio": (9, 10), "width": 3}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs(table(spark, sf_dir, "files"), "file_id", "path", "size", **NEAR_FILES)
    return pairs.select(F.col("key_a").alias("file_id_a"), F.col("key_b").alias("file_id_b"))


def p5_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, by the weighted similarity of the bags of substrings: each counts as often as it occurs in a path."""
    pairs = near_pairs(table(spark, sf_dir, "files"), "file_id", "path", "size", weighted=True, **NEAR_FILES)
    return pairs.select(F.col("key_a").alias("file_id_a"), F.col("key_b").alias("file_id_b"), F.round("similarity", 6).alias("similarity"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with a near-duplicate, its group and its number of links."""
    return near_groups(table(spark, sf_dir, "files"), "file_id", "path", size="size", **NEAR_FILES)


#: A public byte-level BPE; its path may be set for a cluster that keeps it elsewhere.
VOCABULARY = os.environ.get("TEPHRA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every split text must keep: its characters once, in pieces none of which is over the limit."""
    cuts = _pieces(spark, sf_dir, with_text=False)
    settings = table(spark, sf_dir, "swarm_configs").groupBy("source").agg(F.min_by("chunk_size", "config_id").alias("chunk_size"))
    limits = table(spark, sf_dir, "documents").select("doc_id", "source").join(settings, "source", "left").select("doc_id", F.coalesce("chunk_size", F.lit(1024)).alias("most"))
    per = cuts.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("fresh_pos")).alias("characters"), F.max("n_bytes").alias("largest"))
    return per.join(limits, "doc_id").select("doc_id", "characters", (F.col("largest") > F.col("most")).alias("over"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: every text of a source, all its characters, and no window over its capacity."""
    placed = p8_windows(spark, sf_dir)
    over = placed.groupBy("source", "capacity", "block", "window").agg(F.sum("tokens").alias("tokens")).groupBy("source").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("over"))
    kept = placed.groupBy("source").agg(F.count_distinct("doc_id").alias("texts"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("characters"))
    return kept.alias("k").join(over.alias("o"), F.col("k.source").eqNullSafe(F.col("o.source"))).select(F.coalesce("k.source", F.lit("?")).alias("source"), "texts", "characters", "over")


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts, whole or in parts, share which window of context_tokens of their source."""
    settings = table(spark, sf_dir, "swarm_configs").groupBy("source").agg(F.min_by("context_tokens", "config_id").alias("context_tokens"))
    docs = table(spark, sf_dir, "documents").join(settings, "source", "left")
    return pack(docs, "doc_id", "text", "source", docs["context_tokens"], VOCABULARY)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, tokens and filled share of each source."""
    per = p8_windows(spark, sf_dir).groupBy("source", "capacity", "block", "window").agg(F.sum("tokens").alias("tokens"))
    return per.groupBy("source", "capacity").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum("capacity"), 6).alias("filled"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id", run=40, errors=0)


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of 60 letters and digits with up to three of them changed, added or lost."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id", run=60, errors=3)


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p3_found": p3_found, "p3_group_sizes": p3_group_sizes, "p10_found": p10_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_groups": p5_groups, "p5_weighted": p5_weighted, "p4_kept": p4_kept, "p8_kept": p8_kept, "p8_windows": p8_windows, "p8_fill": p8_fill, "p9_found": p9_found, "p9_edited": p9_edited}

_LINKED = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT master_id AS a, duplicate_id AS b FROM match_pairs WHERE similarity >= 85 AND master_id <> duplicate_id
  UNION SELECT DISTINCT duplicate_id, master_id FROM match_pairs WHERE similarity >= 85 AND master_id <> duplicate_id),
reach AS (SELECT a AS file_id, a AS other FROM edges UNION SELECT r.file_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
linked AS (SELECT file_id, min(other) AS group_id FROM reach GROUP BY file_id)
"""

_NEAR = """
WITH RECURSIVE f AS (SELECT DISTINCT file_id, lower(path) AS p, size FROM files WHERE size > 0 AND length(path) >= 3),
g AS (SELECT file_id, size, floor(ln(size) / 0.106)::INT AS k, list_distinct([substr(p, i, 3) for i in range(1, length(p) - 1)]) AS t FROM f),
a AS (SELECT file_id, size, k, len(t) AS n, unnest(t) AS w FROM g),
b AS (SELECT file_id, size, n, w, unnest([k, k + 1]) AS k FROM a),
c AS (SELECT a.file_id AS x, b.file_id AS y, count(*) AS common, any_value(a.n + b.n) AS total FROM a JOIN b ON a.w = b.w AND a.k = b.k
  WHERE b.size <= a.size AND b.size * 10 >= a.size * 9 AND (b.size < a.size OR a.file_id < b.file_id) GROUP BY 1, 2),
near AS (SELECT least(x, y) AS a, greatest(x, y) AS b FROM c WHERE common * 4 >= (total - common) * 3)
"""

SQL = {
    "p1_found": """
WITH members AS (
  SELECT DISTINCT group_id, unnest(list_concat([master], coalesce(duplicates, []))) AS path FROM dup_groups),
copies AS (
  SELECT DISTINCT m.group_id, f.file_id, f.indexed_at, coalesce(s.trust_rank, 1000000) AS trust_rank,
    coalesce(f.created >= TIMESTAMPTZ '1980-01-01 00:00:00+00' AND f.created <= f.indexed_at, false) AS created,
    coalesce(f.modified >= TIMESTAMPTZ '1980-01-01 00:00:00+00' AND f.modified <= f.indexed_at, false) AS modified,
    coalesce(lower(trim(f.thumbnail)) NOT IN ('', 'null', 'n/a'), false) AS thumbnail
  FROM members m JOIN files f ON f.path = m.path LEFT JOIN sources s ON s.source_root = f.source_root),
big AS (SELECT group_id FROM copies GROUP BY group_id HAVING count(DISTINCT file_id) >= 2),
long AS (
  SELECT group_id, 'created' AS field, file_id, indexed_at, trust_rank, 0 AS known FROM copies WHERE created
  UNION ALL SELECT group_id, 'modified', file_id, indexed_at, trust_rank, 0 FROM copies WHERE modified
  UNION ALL SELECT group_id, 'thumbnail', file_id, indexed_at, trust_rank, 0 FROM copies WHERE thumbnail
  UNION ALL SELECT group_id, 'master', file_id, indexed_at, trust_rank, created::INT + modified::INT + thumbnail::INT FROM copies)
SELECT group_id, field, file_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY known DESC, trust_rank, indexed_at DESC, file_id) AS rn
  FROM long WHERE group_id IN (SELECT group_id FROM big)) WHERE rn = 1""",
    "p1_survivors": """
WITH members AS (
  SELECT DISTINCT group_id, unnest(list_concat([master], coalesce(duplicates, []))) AS path FROM dup_groups),
copies AS (
  SELECT DISTINCT m.group_id, f.file_id, f.path, coalesce(f.size, 0) AS size, epoch_us(f.created) AS created_us, epoch_us(f.modified) AS modified_us, f.thumbnail,
    lower(trim(f.hash)) AS hash, lower(trim(f.extension)) AS extension, f.indexed_at, coalesce(s.trust_rank, 1000000) AS rank,
    coalesce(f.created >= TIMESTAMPTZ '1980-01-01 00:00:00+00' AND f.created <= f.indexed_at, false) AS created,
    coalesce(f.modified >= TIMESTAMPTZ '1980-01-01 00:00:00+00' AND f.modified <= f.indexed_at, false) AS modified,
    coalesce(lower(trim(f.thumbnail)) NOT IN ('', 'null', 'n/a'), false) AS shown,
    greatest(coalesce(1000000000 // (1 + s.trust_rank), 1), 1)::HUGEINT
      * greatest(coalesce(1000000 // (1 + greatest((epoch_us((SELECT max(indexed_at) FROM files)) - epoch_us(f.indexed_at)) // 86400000000, 0)), 1), 1) AS vote
  FROM members m JOIN files f ON f.path = m.path LEFT JOIN sources s ON s.source_root = f.source_root),
big AS (SELECT group_id, count(*) AS copies, sum(size)::BIGINT AS bytes FROM copies GROUP BY group_id HAVING count(*) >= 2),
master AS (
  SELECT group_id, path, size FROM copies
  QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY created::INT + modified::INT + shown::INT DESC, rank, indexed_at DESC, file_id) = 1),
made AS (SELECT group_id, created_us FROM copies WHERE created QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rank, indexed_at DESC, file_id) = 1),
changed AS (SELECT group_id, modified_us FROM copies WHERE modified QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rank, indexed_at DESC, file_id) = 1),
pictured AS (SELECT group_id, thumbnail FROM copies WHERE shown QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rank, indexed_at DESC, file_id) = 1),
long AS (
  SELECT group_id, 'hash' AS field, hash AS same, vote, file_id FROM copies WHERE hash <> ''
  UNION ALL SELECT group_id, 'size', size::VARCHAR, vote, file_id FROM copies WHERE size > 0
  UNION ALL SELECT group_id, 'extension', extension, vote, file_id FROM copies WHERE extension <> ''),
summed AS (
  SELECT group_id, field, same, sum(vote) OVER (PARTITION BY group_id, field, same) AS votes, vote AS most, file_id FROM long
  QUALIFY row_number() OVER (PARTITION BY group_id, field, same ORDER BY vote DESC, file_id) = 1),
won AS (SELECT group_id, field, same FROM summed QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY votes DESC, most DESC, file_id) = 1)
SELECT b.group_id, b.copies, m.path AS master, coalesce(created_us, 0) AS created_us, coalesce(modified_us, 0) AS modified_us, p.thumbnail, h.same AS hash, coalesce(s.same::BIGINT, 0) AS size, x.same AS extension, b.bytes - m.size AS wasted_bytes
FROM big b JOIN master m ON m.group_id = b.group_id LEFT JOIN made c ON c.group_id = b.group_id LEFT JOIN changed d ON d.group_id = b.group_id LEFT JOIN pictured p ON p.group_id = b.group_id
LEFT JOIN won h ON h.group_id = b.group_id AND h.field = 'hash' LEFT JOIN won s ON s.group_id = b.group_id AND s.field = 'size' LEFT JOIN won x ON x.group_id = b.group_id AND x.field = 'extension'""",
    "p3_found": _LINKED + "SELECT file_id, group_id FROM linked",
    "p4_found": r"""
WITH sized AS (
  SELECT d.doc_id, d.text, coalesce(c.chunk_size, 1024) AS n FROM documents d LEFT JOIN swarm_configs c ON d.source = c.source),
large AS (SELECT * FROM sized WHERE strlen(text) > n),
longest AS (
  SELECT doc_id, max(strlen(part)) AS bytes FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r。！？]')) AS part FROM large) GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN g.bytes > l.n THEN 'forced' ELSE 'natural' END AS cut FROM large l JOIN longest g ON g.doc_id = l.doc_id""",
    "p5_found": _NEAR + "SELECT a AS file_id_a, b AS file_id_b FROM near",
    "p5_groups": _NEAR
    + """, ends AS (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT x, x AS y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x),
grouped AS (SELECT x, min(y) AS group_id FROM reach GROUP BY x)
SELECT g.x AS file_id, n.links, g.group_id FROM grouped g JOIN (SELECT x, count(*) AS links FROM ends GROUP BY x) n ON n.x = g.x""",
    "p5_weighted": """
WITH f AS (SELECT DISTINCT file_id, lower(path) AS p, size FROM files WHERE size > 0 AND length(path) >= 3),
g AS (SELECT file_id, size, floor(ln(size) / 0.106)::INT AS k, length(p) - 2 AS n, unnest([substr(p, i, 3) for i in range(1, length(p) - 1)]) AS w FROM f),
a AS (SELECT file_id, size, k, n, w, count(*) AS times FROM g GROUP BY ALL),
b AS (SELECT file_id, size, n, w, times, unnest([k, k + 1]) AS k FROM a),
c AS (SELECT a.file_id AS x, b.file_id AS y, sum(least(a.times, b.times)) AS common, any_value(a.n + b.n) AS total FROM a JOIN b ON a.w = b.w AND a.k = b.k
  WHERE b.size <= a.size AND b.size * 10 >= a.size * 9 AND (b.size < a.size OR a.file_id < b.file_id) GROUP BY 1, 2)
SELECT least(x, y) AS file_id_a, greatest(x, y) AS file_id_b, round(common::DOUBLE / (total - common), 6) AS similarity FROM c WHERE common * 4 >= (total - common) * 3""",
    "p4_kept": """
SELECT d.doc_id, length(text) AS characters, false AS over FROM documents d LEFT JOIN swarm_configs c ON d.source = c.source WHERE strlen(text) > coalesce(c.chunk_size, 1024)""",
    "p8_kept": """SELECT coalesce(source, '?') AS source, count(DISTINCT doc_id) AS texts, sum(length(text))::BIGINT AS characters, 0 AS over FROM documents WHERE text IS NOT NULL GROUP BY source""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') AS t FROM documents),
i AS (SELECT DISTINCT item_id, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') AS t FROM eval_items),
dw AS (SELECT doc_id, unnest([substr(t, k, 40) for k in range(1, length(t) - 38)]) AS w FROM d),
iw AS (SELECT DISTINCT item_id, unnest([substr(t, k, 40) for k in range(1, length(t) - 38)]) AS w FROM i)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)""",
    "p3_group_sizes": _LINKED + "SELECT group_id, count(*) AS files FROM linked GROUP BY 1",
}
