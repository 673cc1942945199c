"""Joins and set operations on product ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.ranking import global_index
from shelfmark.schema import CHUNK_ROWS


def intersect_ids(metadata: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids in the metadata and in every embedding type there is."""
    n_types = embeddings.agg(F.count_distinct("embedding_type").alias("n"))
    pairs = embeddings.select("pid", "embedding_type").distinct()
    complete = pairs.groupBy("pid").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_types.scalar())
    return metadata.select("pid").distinct().join(complete.select("pid"), "pid", "left_semi")


def attach_embeddings(products: DataFrame, embeddings: DataFrame, types: Sequence[str]) -> DataFrame:
    """One ``<type>_embedding`` column per type, NULL where there is none. The types are
    folded into one row per id before a single join."""
    wide = embeddings.groupBy("pid").agg(
        *[
            F.first(F.when(F.col("embedding_type") == t, F.col("embedding")), ignorenulls=True).alias(f"{t}_embedding")
            for t in types
        ]
    )
    return products.join(wide, "pid", "left")


def dedup_first(df: DataFrame, order_by: str, key: str = "pid") -> DataFrame:
    """The first row per key. The rank limit is applied before the shuffle too, so a
    key with very many copies moves one row per task."""
    order = Window.partitionBy(key).orderBy(order_by)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def insert_if_absent(existing: DataFrame, new: DataFrame, order_by: str | None = None, key: str = "pid") -> DataFrame:
    """Existing rows and those new ones whose key is not there yet."""
    first = dedup_first(new, order_by, key) if order_by else new.dropDuplicates([key])
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


def append_new_ids(index: DataFrame, new: DataFrame) -> DataFrame:
    """Unseen pids, numbered on from the largest ``vector_id`` of the index."""
    unseen = new.select("pid").distinct().join(index.select("pid"), "pid", "left_anti")
    top = index.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).alias("m"))
    return global_index(unseen, ["pid"], "vector_id", F.lit(1) + top.scalar())


def id_mapping(rows: DataFrame, order_by: str) -> DataFrame:
    """Position in the input order for every pid; the last of several copies wins."""
    numbered = global_index(rows.select("pid", order_by), [order_by], "vector_id")
    return numbered.groupBy("pid").agg(F.max("vector_id").alias("vector_id"))


def chunk_assign(df: DataFrame, order_by: str, size: int = CHUNK_ROWS) -> DataFrame:
    numbered = global_index(df, [order_by], "_row")
    return numbered.withColumn("chunk", F.floor(F.col("_row") / size).cast("int")).drop("_row")


def chunk_gap_report(chunks: DataFrame) -> DataFrame:
    """Chunk numbers below the chunk count that are absent, per embedding type."""
    present = chunks.select("embedding_type", "chunk").distinct()
    counts = present.groupBy("embedding_type").agg(F.count(F.lit(1)).alias("_n"))
    expected = counts.select(
        "embedding_type", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("chunk")
    )
    return expected.join(present, ["embedding_type", "chunk"], "left_anti")


def hit_test(targets: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Whether each query's target id is among its first k results, and where."""
    found = results.filter(F.col("rank") <= k).select("query_id", F.col("pid").alias("target"), "rank")
    return targets.join(found, ["query_id", "target"], "left").withColumn("hit", F.col("rank").isNotNull())
