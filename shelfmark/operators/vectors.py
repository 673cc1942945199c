"""Vector tables: normalising, joining, checking, exact search, re-scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vectors as V
from shelfmark.functions.ranking import normalize_top
from shelfmark.operators.nearest import DEFAULT_BLOCKS, BlockSizes, nearest


def l2_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, V.l2_normalize(F.col(column)))


def concat_embeddings(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Image vector followed by text vector, matched by id rather than by position."""
    left = images.select("pid", F.col("embedding").alias("_image"))
    right = texts.select("pid", F.col("embedding").alias("_text"))
    joined = left.join(right, "pid")
    return joined.select("pid", F.concat(V.as_double(F.col("_image")), V.as_double(F.col("_text"))).alias("embedding"))


def fuse_query_embedding(queries: DataFrame) -> DataFrame:
    """Add ``embedding`` from ``image_vec``, ``image_text_vec`` and ``sentence_vec``."""
    return queries.withColumn("embedding", V.fuse(F.col("image_vec"), F.col("image_text_vec"), F.col("sentence_vec")))


def embedding_dim_check(embeddings: DataFrame) -> DataFrame:
    """Width per embedding type; ``consistent`` is false where lengths differ."""
    width = F.size("embedding")
    return (
        embeddings.groupBy("embedding_type")
        .agg(F.min(width).alias("min_dim"), F.max(width).alias("max_dim"), F.count(F.lit(1)).alias("n"))
        .withColumn("consistent", F.col("min_dim") == F.col("max_dim"))
    )


def knn_exact(
    queries: DataFrame, vectors: DataFrame, k: int, normalize: bool = True, blocks: BlockSizes = DEFAULT_BLOCKS
) -> DataFrame:
    """The k most cosine-similar vectors per query; scores divided by the best one."""
    found = nearest(vectors, queries, k, "cosine", blocks=blocks)
    return normalize_top(found, style="text") if normalize else found


def rescore_cosine(candidates: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score given (query_id, pid) pairs again by cosine on the stored vectors."""
    pairs = candidates.select("query_id", "pid").distinct()
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    v = vectors.select("pid", F.col("embedding").alias("_v"))
    return (
        pairs.join(v, "pid")
        .join(q, "query_id")
        .select("query_id", "pid", V.cosine(F.col("_q"), F.col("_v")).alias("score"))
        .filter(F.col("score").isNotNull())
    )
