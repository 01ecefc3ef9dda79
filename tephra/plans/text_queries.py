"""Chunking, keyword, vector and hybrid search over documents and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts, vectors
from ..operators import chunking, nearest, text_search
from ..runtime import table

# Letters, numbers and the vowel signs of the scripts in the tables, which the JVM counts as alphabetic.
_WORD = r"\p{L}\p{N}\x{0610}-\x{061A}\x{064B}-\x{0657}\x{0659}-\x{065F}\x{0670}\x{0900}-\x{0903}\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}\x{0E31}\x{0E34}-\x{0E3A}\x{0E4D}"
_TOKENS = rf"""
WITH tok AS (SELECT doc_id, unnest([t for t in regexp_split_to_array(lower(text), '[^{_WORD}]+') if strlen(t) >= 2]) AS term FROM documents)
"""
_KEYWORDS = (
    _TOKENS
    + """, q AS (SELECT * FROM (VALUES ('partial', 1.0), ('index', 2.0), ('retry', 1.0)) v(term, weight)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
cf AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY 1),
raw AS (SELECT doc_id, sum(tf * weight * (ln((SELECT count(*) FROM documents) / cf) + 1)) AS raw FROM tf JOIN cf USING (term) JOIN q USING (term) GROUP BY 1),
kw AS (SELECT doc_id, CASE WHEN (SELECT max(raw) FROM raw) > 0 THEN raw / (SELECT max(raw) FROM raw) ELSE raw END AS keyword_score FROM raw)
"""
)
_QUERY = "partial index, index retry"
_HASHED = """
, hv AS (SELECT doc_id, text, [('0x' || substr(h, 2 * i + 1, 2))::INT / 255.0::DOUBLE * 2.0 - 1.0 for i in range(32)] AS v FROM (SELECT doc_id, text, sha256(text) AS h FROM documents)),
qv AS (SELECT [('0x' || substr(sha256('partial index, index retry'), 2 * i + 1, 2))::INT / 255.0::DOUBLE * 2.0 - 1.0 for i in range(32)] AS v),
vec AS (SELECT doc_id, list_cosine_similarity(hv.v::DOUBLE[], qv.v::DOUBLE[]) AS vector_score FROM hv, qv)
"""

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@_query(_TOKENS + "SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS documents FROM (SELECT term, doc_id, count(*) AS n FROM tok GROUP BY 1, 2) GROUP BY 1")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.vocabulary(_docs(spark, sf_dir), "doc_id", "text")


@_query(_KEYWORDS + "SELECT doc_id, round(keyword_score, 6) AS keyword_score FROM kw")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.keyword_scores(_docs(spark, sf_dir), "doc_id", "text", _QUERY).select("doc_id", F.round("keyword_score", 6).alias("keyword_score"))


@_query(None)
def keyword_scores_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.keyword_scores(_docs(spark, sf_dir), "doc_id", "text", "recovred partiton", fuzzy=True)


@_query(None)
def jaro_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = text_search.postings(_docs(spark, sf_dir), "doc_id", "text").select("term").distinct()
    return text_search.similar_terms(terms, ["partition", "manifest"])


@_query(
    _KEYWORDS
    + _HASHED
    + """SELECT doc_id, round(coalesce(keyword_score, 0), 6) AS keyword_score, round(coalesce(vector_score, 0), 6) AS vector_score,
round(coalesce(keyword_score, 0) * 0.3 + coalesce(vector_score, 0) * 0.7, 6) AS score
FROM kw FULL JOIN (SELECT * FROM vec WHERE vector_score > 0) USING (doc_id)
WHERE coalesce(keyword_score, 0) * 0.3 + coalesce(vector_score, 0) * 0.7 >= 0.1"""
)
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document over the least score."""
    found = text_search.hybrid(_docs(spark, sf_dir), "doc_id", "text", _QUERY, vectors.hash_embedding(F.col("text"), 32, False), vectors.hash_embedding(F.lit(_QUERY), 32, False), limit=None)
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("keyword_score", "vector_score", "score")))


@_query(
    _KEYWORDS
    + _HASHED
    + """, scored AS (SELECT doc_id, coalesce(keyword_score, 0) AS keyword_score, coalesce(vector_score, 0) AS vector_score,
  coalesce(keyword_score, 0) * 0.3::DOUBLE + coalesce(vector_score, 0) * 0.7::DOUBLE AS score FROM kw FULL JOIN (SELECT * FROM vec WHERE vector_score > 0) USING (doc_id)),
top AS (SELECT doc_id, keyword_score, vector_score, score * (1.0::DOUBLE + 0.1::DOUBLE / (1.0::DOUBLE + 30 / 24.0::DOUBLE)) AS score FROM scored WHERE score >= 0.1 ORDER BY round(score, 9) DESC, doc_id LIMIT 100),
placed AS (SELECT top.*, d.text, lower(d.text) AS low,
  coalesce(least(nullif(instr(lower(d.text), 'partial'), 0), nullif(instr(lower(d.text), 'index'), 0), nullif(instr(lower(d.text), 'retry'), 0)) - 1, 0) AS place FROM top JOIN documents d USING (doc_id)),
cut AS (SELECT *, greatest(place - 75, 0) AS a FROM placed)
SELECT doc_id, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(score, 6) AS score,
CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text, a + 1, 150) || CASE WHEN a + 150 < length(text) THEN '...' ELSE '' END AS snippet,
concat_ws(',', CASE WHEN contains(low, 'partial') THEN 'partial' END, CASE WHEN contains(low, 'index') THEN 'index' END, CASE WHEN contains(low, 'index') THEN 'index' END, CASE WHEN contains(low, 'retry') THEN 'retry' END) AS matched_terms FROM cut"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report with snippets."""
    found = text_search.hybrid(_docs(spark, sf_dir), "doc_id", "text", _QUERY, vectors.hash_embedding(F.col("text"), 32), vectors.hash_embedding(F.lit(_QUERY), 32), age_hours=F.lit(30.0))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("keyword_score", "vector_score", "score")), "snippet", "matched_terms")


@_query(
    """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS key, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query, key, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, key)::INT AS rank FROM s) WHERE rank <= 10"""
)
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "key", F.round("similarity", 6).alias("similarity"), "rank")


@_query(
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20"""
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    one = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("wanted")).limit(1))
    return text_search.top_k(rows.join(one), "vec_id", F.col("embedding"), F.col("wanted"), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@_query("SELECT vec_id, len(embedding)::INT AS dim, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS norm FROM embeddings")
def embedding_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@_query("SELECT label, count(*) AS vectors, count(*) FILTER (WHERE len(embedding) > 0 AND len([x for x in embedding if isnan(x) OR isinf(x)]) = 0) AS valid FROM embeddings GROUP BY label")
def embedding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(vectors.is_valid(F.col("embedding"))).alias("valid"))


@_query("SELECT count(text) AS requests, count(DISTINCT sha256(text)) AS misses, count(text) - count(DISTINCT sha256(text)) AS hits FROM documents")
def embed_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.cache_statistics(_docs(spark, sf_dir), "text")


@_query(
    """SELECT doc_id, round(list_sum([(('0x' || substr(h, 2 * (i % 32) + 1, 2))::INT / 255.0::DOUBLE * 2.0 - 1.0) for i in range(48)]), 6) AS total
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL)"""
)
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different text embedded once; the sum of its 48 numbers stands for the vector here."""
    made = text_search.embedded(_docs(spark, sf_dir).where("text IS NOT NULL"), "doc_id", "text", 48, lambda t, n: vectors.hash_embedding(t, n, False))
    return made.select("doc_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query(
    r"""SELECT doc_id, matches, round(least(ln(matches) / 10 + 0.5, 1.0), 6) AS score
FROM (SELECT doc_id, len(regexp_extract_all(text, '[Bb]lock \d+')) AS matches FROM documents) WHERE matches > 0"""
)
def regex_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_search.regex_search(_docs(spark, sf_dir), "doc_id", "text", r"[Bb]lock \d+")
    return found.select("doc_id", F.col("matches").cast("long").alias("matches"), F.round("score", 6).alias("score"))


@_query(
    """WITH n AS (SELECT doc_id, text, (length(text) + 1023) // 1024 AS total FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, total, unnest(range(total)) AS index FROM n),
p AS (SELECT *, CASE WHEN index > 0 THEN 128 ELSE 0 END AS lead FROM c)
SELECT doc_id, index::INT AS index, total::INT AS total, (index * 1024 - lead)::INT AS start_pos, substring(text, index * 1024 - lead + 1, lead + 1024) AS content FROM p"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(_docs(spark, sf_dir), "doc_id", "text")


@_query(None)
def chunk_by_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return chunking.by_media(docs, "doc_id", "text", F.concat(docs["doc_id"].cast("string"), F.lit(".txt")), docs["media_type"]).select("doc_id", "index", "total", "start_pos", "end_pos", "media_type", F.map_entries("metadata").cast("string").alias("metadata"), "content")


@_query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, length(regexp_extract(line, '^\s*(#{1,6}) ', 1)) AS level FROM l)
SELECT doc_id, level::INT AS level, count(*) AS headings FROM h WHERE level > 0 GROUP BY 1, 2"""
)
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", texts.heading_level(F.col("line")).alias("level")).where("level > 0").groupBy("doc_id", "level").agg(F.count("*").alias("headings"))


@_query(
    """SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM documents"""
)
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(texts.html_escaped(F.col("text")), 256).alias("digest"))


@_query(
    """WITH p AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'index') > 0 THEN instr(lower(text), 'index') - 1 ELSE 0 END AS place FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, greatest(place - 75, 0) AS a FROM p)
SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text, a + 1, 150) || CASE WHEN a + 150 < length(text) THEN '...' ELSE '' END AS snippet,
CASE WHEN contains(lower(text), 'index') THEN 'index' ELSE '' END AS matched FROM s"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    return docs.select("doc_id", texts.snippet(F.col("text"), ["index"]).alias("snippet"), texts.matched_terms(F.col("text"), ["index"]).alias("matched"))
