"""Facet, price and page queries over hydrated hybrid results and over whole sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import facets
from shelfmark.registry.base import query, table
from shelfmark.registry.hybrid import RESULTS, results

# Line items as result lists: an order is a query, its parts are the results.
LISTS = """lists AS (SELECT l_orderkey AS query_id, l_partkey AS pid,
    CASE WHEN p_size > 45 THEN NULL ELSE p_brand END AS brand, concat(p_type, ' > ', p_name) AS category,
    CASE WHEN p_size < 5 THEN NULL WHEN p_size = 6 THEN 'NaN'::DOUBLE ELSE p_retailprice END AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_partkey").alias("pid"),
        F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("brand"),
        F.concat("p_type", F.lit(" > "), "p_name").alias("category"),
        F.when(F.col("p_size") == 6, F.lit(float("nan"))).when(F.col("p_size") >= 5, F.col("p_retailprice")).alias("price"),
    )


def share_sql(facet: str) -> str:
    return f"""SELECT query_id, coalesce({facet}, 'None') AS value,
      CAST(round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY query_id), 0) AS INTEGER) AS share FROM lists GROUP BY 1, 2"""


@query("facet_share", f"WITH {LISTS} {share_sql('brand')}")
def facet_share(spark, sf_dir):
    return facets.facet_share(lists(spark, sf_dir), "brand")


@query(
    "price_stats",
    f"""WITH {LISTS}, priced AS (SELECT query_id, CASE WHEN NOT isnan(price) THEN price END AS price FROM lists)
    SELECT query_id, round(min(price), 2) AS min_price, round(max(price), 2) AS max_price,
    (2 * CAST(sum(CAST(price AS DECIMAL(18, 4))) * 10000 AS BIGINT) + 100 * count(price)) // (200 * count(price)) / 100.0::DOUBLE AS avg_price
    FROM priced GROUP BY 1""",
)
def price_stats(spark, sf_dir):
    return facets.price_stats(lists(spark, sf_dir))


@query(
    "category_rollup",
    f"""WITH {LISTS}, s AS ({share_sql('category')}) SELECT query_id, trim(split_part(value, '>', 1)) AS category, CAST(sum(share) AS BIGINT) AS share FROM s GROUP BY 1, 2""",
)
def category_rollup(spark, sf_dir):
    return facets.category_rollup(facets.facet_share(lists(spark, sf_dir), "category"))


@query(
    "top_brands",
    f"""WITH {LISTS}, s AS ({share_sql('brand')}) SELECT query_id, value, share, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, value) AS rank FROM s) WHERE rank <= 5""",
)
def top_brands(spark, sf_dir):
    return facets.top_brands(facets.facet_share(lists(spark, sf_dir), "brand"))


@query("paginate", f"{RESULTS} SELECT query_id, pid, rank FROM results WHERE rank BETWEEN 21 AND 40")
def paginate(spark, sf_dir):
    return facets.paginate(results(spark, sf_dir), 2).select("query_id", "pid", "rank")


def _distribution(facet: str) -> str:
    return f"""{facet}_share AS (SELECT query_id, string_agg(concat({facet}, '=', CAST(share AS VARCHAR)), ';' ORDER BY {facet}) AS {facet}_distribution FROM (
      SELECT query_id, {facet}, CAST(round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY query_id), 0) AS INTEGER) AS share
      FROM results GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "search_response",
    f"""{RESULTS}, {_distribution('category')}, {_distribution('brand')},
    asked AS (SELECT DISTINCT p_name AS query_id FROM part),
    listed AS (SELECT query_id, string_agg(concat(CAST(rank AS VARCHAR), ':', CAST(pid AS VARCHAR), ':', name), ';' ORDER BY rank) AS results,
      round(min(price), 2) AS min_price, round(max(price), 2) AS max_price,
      (2 * CAST(sum(CAST(price AS DECIMAL(18, 4))) * 10000 AS BIGINT) + 100 * count(price)) // (200 * count(price)) / 100.0::DOUBLE AS avg_price
      FROM results GROUP BY 1)
    SELECT query_id, coalesce(results, '') AS results, min_price, max_price, avg_price, category_distribution, brand_distribution
    FROM asked LEFT JOIN listed USING (query_id) LEFT JOIN category_share USING (query_id) LEFT JOIN brand_share USING (query_id)""",
)
def search_response(spark, sf_dir):
    found = results(spark, sf_dir).select("query_id", "rank", "pid", "score", "name", "brand", "category", "price")
    shares = {name: facets.facet_share(found, name) for name in ("category", "brand")}
    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id")).distinct()
    out = facets.search_response(asked, found, shares)

    def entries(column: str):
        pairs = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(pairs, ";").alias(column)

    line = F.transform("results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["pid"].cast("string"), r["name"]))
    return out.select(
        "query_id", F.array_join(line, ";").alias("results"), "min_price", "max_price", "avg_price",
        entries("category_distribution"), entries("brand_distribution"),
    )
