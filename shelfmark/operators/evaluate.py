"""Recall, precision and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_COLUMNS = ["basic_query", "attribute_query", "natural_query"]


def unpivot_queries(benchmark: DataFrame, ids: Sequence[str], columns: Sequence[str] = QUERY_COLUMNS) -> DataFrame:
    return benchmark.unpivot(list(ids), list(columns), "query_type", "query")


def _cents(c: Column) -> Column:
    """Two decimals by way of a decimal number, so that the last bits of a mean do not
    decide a tie."""
    return F.round(c.cast("decimal(18,6)"), 2).cast("double")


def _recall(hit: str) -> Column:
    return _cents(F.avg(F.col(hit).cast("int")))


def recall_at_k(tested: DataFrame) -> DataFrame:
    """Share of hits overall (query_type NULL) and per query type, from ``hit_test`` rows."""
    return tested.groupingSets([[], ["query_type"]], "query_type").agg(
        F.count(F.lit(1)).alias("queries"), _recall("hit").alias("recall")
    )


def recall_breakdown(tested: DataFrame) -> DataFrame:
    """Overall, per type, and per category and type, in one pass. ``level`` tells a total
    from a NULL category."""
    sets = [[], ["query_type"], ["category", "query_type"]]
    return tested.groupingSets(sets, "category", "query_type").agg(
        F.grouping_id("category", "query_type").cast("int").alias("level"),
        F.count(F.lit(1)).alias("queries"),
        _recall("hit").alias("recall"),
    )


def precision_at_k(results: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """Relevant results among the first k, divided by k even if fewer came back."""
    shown = results.filter(F.col("rank") <= k).join(judgements.select("pid", "relevant"), "pid")
    return shown.groupBy("query_id").agg((F.count_if("relevant") / k).alias("precision"))


def mean_by_type(precisions: DataFrame) -> DataFrame:
    return precisions.groupBy("query_type").agg(F.avg("precision").alias("mean_precision"))


def best_config(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best run, or the best per group: highest recall, then fewest probes."""
    order = F.struct(F.col("recall"), (-F.col("nprobe")).alias("fewer"))
    grouped = runs.groupBy(*by) if by else runs.groupBy()
    return grouped.agg(F.max_by("nprobe", order).alias("nprobe"), F.max("recall").alias("recall"))


def duration_parse(runs: DataFrame, queries: int = 300) -> DataFrame:
    """Seconds per query from texts like '21.2min'."""
    minutes = F.regexp_replace("duration", "min", "").try_cast("double")
    return runs.withColumn("search_time", minutes * 60 / queries)


def metric_summary(recalls: DataFrame, precisions: DataFrame, times: DataFrame) -> DataFrame:
    """One row per method and query type with recall, precision and search time."""
    return (
        recalls.join(precisions, ["method", "query_type"], "left")
        .join(times.select("method", "search_time"), "method", "left")
        .select("method", "query_type", "recall", _cents(F.col("precision")).alias("precision"), "search_time")
    )
