"""Keyword, vector and hybrid search over documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import texts, vectors


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per occurrence: ``key``, term."""
    return docs.select(key, F.explode(texts.tokens(F.col(text))).alias("term"))


def vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Terms with their number of occurrences and of documents."""
    per = postings(docs, key, text).groupBy("term", key).agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def query_terms(text: str) -> list[str]:
    """Terms of a query, repeats and all, by the rule of ``texts.tokens``."""
    word, out = "", []
    for c in text.lower() + " ":
        if c.isalpha() or c.isnumeric():
            word += c
            continue
        if len(word.encode()) >= 2:
            out.append(word)
        word = ""
    return out


def jaro(a: str, b: str) -> float:
    """Jaro similarity by characters, counting half transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, first = list(range(len(b))), []
    for i, c in enumerate(a):
        hit = next((j for j in free if i - reach <= j <= i + reach and b[j] == c), None)
        if hit is not None:
            free.remove(hit)
            first.append((c, hit))
    if not first:
        return 0.0
    m = len(first)
    moved = sum(c != b[j] for (c, _), j in zip(first, sorted(j for _, j in first)))
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity of two columns."""
    return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_terms(terms: DataFrame, query: list[str], least: float = 0.7) -> DataFrame:
    """Terms near a word of the query but not equal to it: word, term, similarity.

    The few words of the query are an array literal exploded next to each distinct term, so nothing is shuffled.
    """
    paired = terms.select("term", F.explode(F.array(*(F.lit(q) for q in dict.fromkeys(query)))).alias("word"))
    scored = paired.withColumn("similarity", jaro_similarity(F.col("word"), F.col("term")))
    return scored.where((F.col("similarity") >= least) & (F.col("word") != F.col("term"))).select("word", "term", "similarity")


def keyword_scores(docs: DataFrame, key: str, text: str, query: str, fuzzy: bool = False, least: float = 0.7) -> DataFrame:
    """``key``, keyword_score: sum over occurrences of ln(documents / occurrences in all) + 1, scaled to 1 if the best is above 0.

    A word that the query repeats counts as often; with ``fuzzy``, words nearly equal count half, times
    their similarity. Only occurrences of wanted words leave the scan.
    """
    words = query_terms(query)
    weight = {w: float(words.count(w)) for w in words}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(w, n) for w, n in weight.items()], "term string, weight double")
    if fuzzy and words:
        near = similar_terms(postings(docs, key, text).select("term").distinct(), words, least)
        repeats = F.create_map(*(F.lit(x) for w, n in weight.items() for x in (w, n)))
        extra = near.groupBy("term").agg(F.sum(F.col("similarity") * 0.5 * repeats[F.col("word")]).alias("weight"))
        wanted = wanted.unionByName(extra).groupBy("term").agg(F.sum("weight").alias("weight"))
        per = postings(docs, key, text).join(wanted, "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("weight").alias("weight"))
    else:
        some = F.filter(texts.tokens(F.col(text)), lambda t: t.isin(list(weight)))
        per = docs.select(key, F.explode(some).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")).join(F.broadcast(wanted), "term")
    all_docs = docs.agg(F.count("*").alias("docs"))
    icf = per.groupBy("term").agg(F.sum("tf").alias("occurrences"))
    rated = per.join(icf, "term").join(F.broadcast(all_docs))
    score = rated.groupBy(key).agg(F.sum(F.col("tf") * F.col("weight") * (F.log(F.col("docs") / F.col("occurrences")) + 1)).alias("raw"))
    best = F.broadcast(score.agg(F.max("raw").alias("best")))
    return score.join(best).select(key, F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(F.col("raw")).alias("keyword_score"))


def vector_scores(docs: DataFrame, key: str, vector: Column, query: Column) -> DataFrame:
    """``key``, vector_score of every document whose cosine with the query is above 0."""
    return docs.select(key, vectors.cosine(vector, query).alias("vector_score")).where("vector_score > 0")


def top_k(docs: DataFrame, key: str, vector: Column, query: Column, k: int) -> DataFrame:
    """The ``k`` nearest by cosine; ties go to the smaller key."""
    return docs.select(key, vectors.cosine(vector, query).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def hybrid(docs: DataFrame, key: str, text: str, query: str, vector: Column, query_vector: Column, keyword_weight: float = 0.3, vector_weight: float = 0.7, least: float = 0.1, limit: int | None = 100, fuzzy: bool = False, age_hours: Column | None = None) -> DataFrame:
    """Keyword and vector scores joined, a missing one 0, weighed, cut at ``least``, best first: with snippet and matched terms.

    With ``age_hours`` the score gets a boost for recent documents. The text is joined back only for what is returned.
    """
    words = query_terms(query)
    a = keyword_scores(docs, key, text, query, fuzzy)
    b = vector_scores(docs, key, vector, query_vector)
    both = a.join(b, key, "full_outer").select(key, F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"))
    found = both.withColumn("score", F.col("keyword_score") * keyword_weight + F.col("vector_score") * vector_weight).where(F.col("score") >= least)
    if age_hours is not None:
        found = found.join(docs.select(key, age_hours.alias("age_hours")), key).withColumn("score", F.col("score") * texts.recency_factor(F.col("age_hours"))).drop("age_hours")
    if limit is not None:
        found = found.orderBy(F.desc(F.round("score", 9)), key).limit(limit)  # sums in another order mustn't decide between equals
    content = docs.select(key, texts.snippet(F.col(text), words).alias("snippet"), texts.matched_terms(F.col(text), words).alias("matched_terms"))
    return found.join(content, key)


def regex_search(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key``, matches, score (0.5 + ln(matches) / 10, at most 1) of documents in which the pattern is found."""
    n = F.regexp_count(F.col(text), F.lit(pattern))
    return docs.select(key, n.alias("matches")).where("matches > 0").withColumn("score", F.least(F.log("matches") / 10 + 0.5, F.lit(1.0)))


def embedded(docs: DataFrame, key: str, text: str, size: int, embed=vectors.hash_embedding) -> DataFrame:
    """``key``, vector: each different text is embedded once, by its content hash, and joined back to all that have it."""
    hashed = docs.select(key, F.sha2(text, 256).alias("content"), text)
    once = hashed.groupBy("content").agg(F.any_value(text).alias("one")).select("content", embed(F.col("one"), size).alias("vector"))
    return hashed.select(key, "content").join(once, "content").select(key, "vector")


def cache_statistics(docs: DataFrame, text: str) -> DataFrame:
    """What such a cache spares: requests, misses, hits."""
    return docs.agg(F.count(text).alias("requests"), F.countDistinct(F.sha2(text, 256)).alias("misses")).withColumn("hits", F.col("requests") - F.col("misses"))


def index_statistics(docs: DataFrame, key: str, text: str, vector: Column) -> DataFrame:
    """One row: documents, different terms, embeddings that aren't empty."""
    terms = postings(docs, key, text).agg(F.countDistinct("term").alias("terms"))
    return docs.agg(F.count("*").alias("documents"), F.count_if(F.size(vector) > 0).alias("embeddings")).join(terms, how="cross").select("documents", "terms", "embeddings")
