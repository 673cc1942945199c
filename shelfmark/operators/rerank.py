"""Reordering the head of a result list by an external model's reply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.schema import NO_REASONING, RERANK_FIELDS, RERANK_WINDOW

# The fields of a model's reply.
_REPLY_SCHEMA = "reordered_indices array<int>, reasoning string"


def rerank_payload(results: DataFrame, window: int = RERANK_WINDOW) -> DataFrame:
    """One JSON list per query with the first rows, numbered from 0, and seven fields."""
    head = results.filter(F.col("rank") <= window)
    fields = [c for c in RERANK_FIELDS if c in results.columns]
    item = F.struct((F.col("rank") - 1).alias("index"), *fields)
    return head.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))


def rerank_parse_reply(replies: DataFrame) -> DataFrame:
    """Indices and reasoning from ``reply``; ``n_items`` is how many were shown.

    The widest ``{...}`` block is read as JSON. Without one, or if it does not parse,
    the order stays as it is and the raw reply is the reasoning.
    """
    block = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    identity = F.when(F.col("n_items") > 0, F.sequence(F.lit(0), F.col("n_items") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    is_object = F.get_json_object(block, "$").isNotNull()
    parsed = replies.withColumn("_p", F.from_json(block, _REPLY_SCHEMA))
    return parsed.select(
        "query_id",
        "n_items",
        F.coalesce("_p.reordered_indices", identity).alias("indices"),
        F.when(is_object, F.coalesce("_p.reasoning", F.lit(NO_REASONING)))
        .otherwise(F.col("reply"))
        .alias("reasoning"),
    )


def rerank_audit(parsed: DataFrame) -> DataFrame:
    """Which shown items the reply left out, and which indices it made up."""
    expected = F.when(F.col("n_items") > 0, F.sequence(F.lit(0), F.col("n_items") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return parsed.select(
        "query_id",
        F.array_sort(F.array_except(expected, "indices")).alias("missing"),
        F.array_sort(F.array_except("indices", expected)).alias("extra"),
    )


def rerank_apply(results: DataFrame, orders: DataFrame, window: int = RERANK_WINDOW) -> DataFrame:
    """Listed items in list order, then unlisted shown items, then the rest.

    ``results(query_id, rank, pid, ...)``, ``orders(query_id, indices)``. An index that
    was not shown voids the whole list of that query; a repeat counts at its first place.
    """
    shown = results.groupBy("query_id").agg(F.least(F.max("rank"), F.lit(window)).alias("_shown"))
    listed = orders.join(shown, "query_id").select(
        "query_id",
        F.when(F.forall("indices", lambda i: i.isNotNull() & (i >= 0) & (i < F.col("_shown"))), F.array_distinct("indices")).alias("_list"),
    )
    place: Column = F.array_position("_list", (F.col("rank") - 1).cast("int"))
    moved = results.join(listed, "query_id", "left").withColumn(
        "_place",
        F.when((F.col("rank") <= window) & (place > 0), place).otherwise(F.lit(window) + F.col("rank")),
    )
    order = Window.partitionBy("query_id").orderBy("_place", "rank")
    return (
        moved.withColumn("_new", F.row_number().over(order))
        .drop("_list", "_place")
        .withColumnRenamed("rank", "old_rank")
        .withColumnRenamed("_new", "rank")
    )


def rerank_rules(results: DataFrame) -> DataFrame:
    """The reordering hints as score terms, from ``query_text, name, brand, price``:
    words shared with the name, a brand mention, and a price below an "under N" limit."""
    query = F.lower("query_text")
    q_words = F.array_distinct(F.regexp_extract_all(query, F.lit("[a-z0-9]+"), F.lit(0)))
    n_words = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)))
    limit = F.regexp_extract(query, r"under \$?([0-9]+)", 1).try_cast("double")
    return results.withColumns(
        {
            "keyword_hits": F.size(F.array_intersect(q_words, n_words)),
            "brand_hit": F.coalesce(F.contains(query, F.lower("brand")), F.lit(False)),
            "price_ok": F.when(limit.isNotNull(), F.coalesce(F.col("price") < limit, F.lit(False))),
        }
    )


def rerank_by_rules(results: DataFrame, window: int = RERANK_WINDOW) -> DataFrame:
    """An order made of the hints, without a model: ``new_rank`` for ``results`` with ``query_id``, ``rank``
    and the columns of ``rerank_rules``.

    Each hint ranks the first ``window`` results of a query, equal ones alike, and the places of
    the three hints and of the retrieval are added up (Borda's count); the least sum comes first,
    and equal sums keep their order. Results beyond the window stay where they are. A query
    without a price limit is not ordered by price.
    """
    scored = rerank_rules(results)
    shown = F.col("rank") <= window
    of_query = Window.partitionBy("query_id", shown)
    hints = [F.col("keyword_hits").desc(), F.col("brand_hit").desc(), F.coalesce("price_ok", F.lit(True)).desc()]
    places = reduce(Column.__add__, [F.rank().over(of_query.orderBy(h)) for h in hints], F.col("rank"))
    placed = scored.withColumn("_sum", F.when(shown, places))
    moved = F.row_number().over(of_query.orderBy("_sum", "rank"))
    return placed.withColumn("new_rank", F.when(shown, moved).otherwise(F.col("rank")).cast("int")).drop("_sum")
