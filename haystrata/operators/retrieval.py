"""Hybrid retrieval over chunks: exact cosine, Okapi BM25, reciprocal rank fusion, confidence.

Both searches read stored indexes (``sources.vectors``, ``sources.postings``): blocks with bounds, of which
a query reads those that can hold one of its best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haystrata.sources import postings, shared, vectors


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)))


def vector_search(chunks: DataFrame, queries: DataFrame, pool: int = 10) -> DataFrame:
    """chunks: chunk_id, seq, embedding; queries: query_id, query_embedding. query_id, chunk_id, seq, vector_similarity, vector_distance, rank.

    For chunks that have no stored index: one is built for this search.
    """
    return vectors.build(chunks, shared.folder(chunks.sparkSession, "vectors")).search(queries, pool)


def bm25_search(chunks: DataFrame, queries: DataFrame, pool: int = 10) -> DataFrame:
    """chunks: chunk_id, seq, text; queries: query_id, query. query_id, chunk_id, seq, bm25, rank; scores above 0 only.

    For chunks that have no stored index: one is built for this search.
    """
    return postings.build(chunks, shared.folder(chunks.sparkSession, "postings")).search(queries, pool)


def fuse(vector: DataFrame, lexical: DataFrame, top_k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion. Ties: the vector list before the lexical one, then the better rank."""
    both = vector.select("query_id", "chunk_id", F.lit(0).alias("list"), "rank", "vector_similarity", "vector_distance").unionByName(
        lexical.select("query_id", "chunk_id", F.lit(1).alias("list"), "rank", F.lit(None).cast("double").alias("vector_similarity"), F.lit(None).cast("double").alias("vector_distance"))
    )
    merged = both.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"),
        F.min(F.struct("list", "rank")).alias("first"),
        F.max("vector_similarity").alias("vector_similarity"),
        F.max("vector_distance").alias("vector_distance"),
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first.list", "first.rank")
    return merged.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= top_k).drop("first")


def confidence(matches: DataFrame, threshold: float = 0.49) -> DataFrame:
    """Per query: best similarity of its fused matches, rounded to six places, against the threshold."""
    rounded = matches.withColumn("sim", F.round("vector_similarity", 6)).withColumn("dist", F.round("vector_distance", 6))
    best = F.max(F.when(F.col("sim").isNotNull(), F.struct("sim", -F.col("position"), "dist")))
    out = rounded.groupBy("query_id").agg(best.alias("best"))
    return out.select(
        "query_id",
        F.lit(threshold).alias("threshold"),
        F.col("best.sim").alias("best_vector_similarity"),
        F.col("best.dist").alias("best_vector_distance"),
        F.coalesce(F.col("best.sim") >= threshold, F.lit(False)).alias("threshold_passed"),
    )
