"""Top-k, score normalisation and row numbering over many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.schema import SCORE_DECIMALS
from shelfmark.session import pinned

_ROW_BITS = 33


def score_key(c: Column | str) -> Column:
    """The score at the precision that ranks are decided on."""
    return F.round(c, SCORE_DECIMALS)


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", tie: str = "pid") -> DataFrame:
    """The k best rows per query, ranked from 1; equal scores go by id.

    Catalyst cuts to k rows per query before the shuffle (WindowGroupLimit), so a
    query that matches a third of the catalog still moves k rows per task.
    """
    order = Window.partitionBy(*by).orderBy(score_key(score).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_per_group(scored: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.max(score).alias("best"))


def max_normalize(scored: DataFrame, by: Sequence[str] = ("query_id",), score: str = "score", style: str = "vector") -> DataFrame:
    """Divide by the best score of the group.

    ``vector`` leaves scores alone when the best is not positive; ``text`` maps a best
    of 0 to 0 and divides by a negative best. The best is a pre-aggregated table joined
    back, not a window, so a hot group is not pulled into one task.
    """
    best = best_per_group(scored, by, score)
    x, m = F.col(score), F.col("best")
    if style == "vector":
        value = F.when(m > 0, x / m).otherwise(x)
    elif style == "text":
        value = F.when(m == 0, F.lit(0.0)).otherwise(F.try_divide(x, m))
    else:
        raise ValueError(f"unknown normalisation style: {style}")
    return scored.join(best, list(by)).withColumn(score, value).drop("best")


def normalize_top(ranked: DataFrame, by: Sequence[str] = ("query_id",), score: str = "score", style: str = "vector") -> DataFrame:
    """The same division for rows already cut to k per query: there a window is the
    cheaper form, as its groups hold at most k rows."""
    x = F.col(score)
    m = F.max(score).over(Window.partitionBy(*by))
    if style == "vector":
        return ranked.withColumn(score, F.when(m > 0, x / m).otherwise(x))
    return ranked.withColumn(score, F.when(m == 0, F.lit(0.0)).otherwise(F.try_divide(x, m)))


def global_index(df: DataFrame, order_by: Sequence[str], name: str = "idx", start: int | Column = 0) -> DataFrame:
    """Consecutive row numbers over the whole table without a one-task window.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted
    by the row counts of the partitions before. The numbered rows are checkpointed, so
    that a lost executor cannot renumber half of them.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    rows = pinned(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", _ROW_BITS)
    # One row per partition, so this window is as small as the partition count.
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (base + F.col("_before") + local).cast("bigint"))
        .drop("_part", "_before", "_slot")
    )


def index_within(df: DataFrame, group: Sequence[str], order_by: Sequence[str], name: str = "pos") -> DataFrame:
    """Row numbers from 1 inside each group. A hot group spans many partitions, because
    the range partitioning is on group *and* order columns."""
    numbered = global_index(df, [*group, *order_by], "_row")
    first = numbered.groupBy(*group).agg(F.min("_row").alias("_first"))
    return (
        numbered.join(first, list(group))
        .withColumn(name, F.col("_row") - F.col("_first") + 1)
        .drop("_row", "_first")
    )
