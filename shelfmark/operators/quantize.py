"""8-bit scalar quantisation per dimension."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vectors as V
from shelfmark.operators.nearest import DEFAULT_BLOCKS, BlockSizes, nearest
from shelfmark.session import pinned

LEVELS = 255
#: Embedding types whose ranges travel to the vectors.
MAX_TYPES = 1000


def sq8_ranges(vectors: DataFrame) -> DataFrame:
    """Smallest and largest value per dimension, one row per embedding type. The vector
    summariser aggregates before the shuffle and never explodes dimensions into rows."""
    v = array_to_vector(V.as_double(F.col("embedding")))
    return (
        vectors.groupBy("embedding_type")
        .agg(Summarizer.metrics("min", "max").summary(v).alias("s"))
        .select("embedding_type", vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))
    )


def _small(ranges: DataFrame) -> DataFrame:
    """One row per embedding type: checked, then sent to the vectors, which stay in place."""
    ranges = pinned(ranges)
    return F.broadcast(ranges) if ranges.count() <= MAX_TYPES else ranges


def sq8_encode(vectors: DataFrame, ranges: DataFrame) -> DataFrame:
    """Codes 0..255 as ARRAY<INT> (a Spark byte is signed)."""

    def code(x, i):
        lo, width = F.get("lo", i), F.get("hi", i) - F.get("lo", i)
        return F.when(width == 0, F.lit(0)).otherwise(F.round(LEVELS * (x - lo) / width, 0)).cast("int")

    joined = vectors.join(_small(ranges), "embedding_type")
    return joined.withColumn("code", F.transform(V.as_double(F.col("embedding")), code)).drop("lo", "hi", "embedding")


def sq8_decode(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    def value(c, i):
        return F.get("lo", i) + c * (F.get("hi", i) - F.get("lo", i)) / LEVELS

    joined = codes.join(_small(ranges), "embedding_type")
    return joined.withColumn("embedding", F.transform("code", value)).drop("lo", "hi", "code")


def sq8_search(queries: DataFrame, codes: DataFrame, ranges: DataFrame, k: int, blocks: BlockSizes = DEFAULT_BLOCKS) -> DataFrame:
    """Top-k by inner product over the decoded codes."""
    return nearest(sq8_decode(codes, ranges), queries, k, "ip", blocks=blocks)
