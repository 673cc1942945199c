"""A query benchmark over several retrieval settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import hybrid
from shelfmark.operators.ids import hit_test


def run_benchmark(queries: DataFrame, catalog: hybrid.Catalog, configs: list[dict], k: int) -> DataFrame:
    """Recall per setting, query type and category.

    ``queries(query_id, query_type, category, target, text, embedding)``. All queries of
    a setting are one set-oriented search, and all settings one plan.
    """
    runs = []
    for config in configs:
        components = hybrid.build_components(config["components"])
        found = hybrid.hybrid_search(queries, catalog, components, config["weights"], k)
        tested = hit_test(queries.select("query_id", "query_type", "category", "target"), found, k)
        runs.append(tested.withColumn("config", F.lit(config["name"])))
    tested = reduce(DataFrame.unionByName, runs)
    sets = [["config"], ["config", "query_type"], ["config", "category", "query_type"]]
    return tested.groupingSets(sets, "config", "category", "query_type").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 2).alias("recall")
    )


