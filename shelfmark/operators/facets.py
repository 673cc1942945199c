"""Result statistics: shares, prices, pages, and the response row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.schema import PAGE_SIZE


def facet_share(results: DataFrame, facet: str) -> DataFrame:
    """Whole percent of each facet value per query, half to even; NULL counts as 'None'."""
    counts = results.groupBy("query_id", F.coalesce(facet, F.lit("None")).alias("value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    totals = counts.groupBy("query_id").agg(F.sum("_n").alias("_total"))
    share = F.bround(F.lit(100.0) * F.col("_n") / F.col("_total"), 0).cast("int")
    return counts.join(totals, "query_id").select("query_id", "value", share.alias("share"))


def price_stats(results: DataFrame, price: str = "price") -> DataFrame:
    """Lowest, highest and mean price to the cent. The mean is over decimals, so it does
    not hang on the order in which rows are summed."""
    p = F.nullif(F.col(price), F.lit(float("nan")))  # no number is no price
    mean = F.avg(p.cast("decimal(18,4)"))
    return results.groupBy("query_id").agg(
        F.round(F.min(p), 2).alias("min_price"),
        F.round(F.max(p), 2).alias("max_price"),
        F.round(mean, 2).cast("double").alias("avg_price"),
    )


def category_rollup(shares: DataFrame) -> DataFrame:
    """Shares summed by the part of the category before the first '>'."""
    base = F.trim(F.split_part("value", F.lit(">"), F.lit(1)))
    return shares.groupBy("query_id", base.alias("category")).agg(F.sum("share").alias("share"))


def top_brands(shares: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("share").desc(), F.col("value"))
    return shares.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def paginate(results: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of ranked results; pages count from 1."""
    return results.filter(F.col("rank").between((page - 1) * size + 1, page * size))


def hydrate_results(ranked: DataFrame, products: DataFrame) -> DataFrame:
    """Product fields for ranked ids. Unknown ids drop out, ranks stay."""
    return ranked.join(products, "pid")


def fetch_by_pids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the asked ids, each once however often it was asked for."""
    return products.join(ids.select("pid"), "pid", "left_semi")


def search_response(queries: DataFrame, results: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """One row per query. Result arrays hold at most k entries, as results are top-k rows;
    a query without results gets an empty array."""
    fields = [c for c in results.columns if c not in ("query_id", "rank")]
    items = results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("results")
    )
    out = queries.join(items, "query_id", "left").join(price_stats(results), "query_id", "left")
    for name, share in shares.items():
        as_map = share.groupBy("query_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "share")))).alias(f"{name}_distribution")
        )
        out = out.join(as_map, "query_id", "left")
    empty = F.array().cast(items.schema["results"].dataType)
    return out.withColumn("results", F.coalesce("results", empty))
