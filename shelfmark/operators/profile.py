"""Table profiles: missing values, distinct values, shares, lengths, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent NULL per column, all columns in one pass."""
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "null_percent")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values per column, exactly. Each column is a scan of its own, which reads
    that column alone and drops what repeats before the shuffle; one pass over all would
    copy every row once for each column."""
    each = [df.agg(F.lit(c).alias("column_name"), F.count_distinct(F.col(c)).alias("n_distinct")) for c in columns]
    return reduce(DataFrame.unionAll, each)


#: Registers of a sketch, as a power of two; its standard error is about 0.81 / sqrt(registers).
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """``*by, column_name, sketch``: a sketch of the different values of each column, for each group of
    rows. Sketches are some kilobytes whatever they counted, can be stored, and those of new
    rows are united with the old ones, so nothing is counted twice or read again."""
    wide = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")


def sketched_counts(sketches: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``column_name, estimate, error``: all sketches of a column united, and the relative standard error."""
    united = sketches.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return united.withColumn("error", F.lit(0.81 / (1 << bits) ** 0.5))


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Percent of rows per value, NULL included."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.lit(100.0) * F.col("n") / total.scalar())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def length_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = []
    for c in columns:
        parts += [F.min(F.length(c)).alias(f"{c}_min"), F.max(F.length(c)).alias(f"{c}_max")]
    wide = df.agg(*parts)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_min").alias("min_length"), F.col(f"{c}_max").alias("max_length"))
        for c in columns
    ]
    return wide.select(F.inline(F.array(*entries)))


def _brand_hit(name: str, brand: str) -> Column:
    return F.contains(F.lower(F.col(name)), F.lower(F.col(brand)))


def brand_in_name(df: DataFrame, name: str, brand: str) -> DataFrame:
    """Rows whose name has the brand in it; rows missing either do not count as hits."""
    hits = F.count_if(_brand_hit(name, brand))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), hits.alias("hits"))
    return counts.withColumn("hit_percent", F.try_divide(F.lit(100.0) * F.col("hits"), F.col("rows")))


def null_share_in_subset(df: DataFrame, name: str, brand: str) -> DataFrame:
    """Among rows whose name lacks the brand: how many have no brand at all."""
    misses = df.filter(~F.coalesce(_brand_hit(name, brand), F.lit(False)))
    counts = misses.agg(F.count(F.lit(1)).alias("misses"), F.count_if(F.col(brand).isNull()).alias("without_brand"))
    return counts.withColumn(
        "without_brand_percent", F.try_divide(F.lit(100.0) * F.col("without_brand"), F.col("misses"))
    )


def branded_misses(df: DataFrame, name: str, brand: str) -> DataFrame:
    """The misses that do have a brand."""
    return df.filter(F.col(brand).isNotNull() & ~F.coalesce(_brand_hit(name, brand), F.lit(False)))


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Several filtered counts from one scan."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
