"""A batch of search requests to response rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import facets, hybrid, rerank
from shelfmark.operators.hybrid import Catalog, Component
from shelfmark.operators.vectors import fuse_query_embedding
from shelfmark.schema import IMAGE_ONLY, NO_MODEL, RERANK_SHARE
from shelfmark.session import pinned

TOP_K = 100


def retrieve(requests: DataFrame, catalog: Catalog, components: dict[str, Component], k: int = TOP_K) -> DataFrame:
    """Ranked (query_id, pid, score, rank) by the weights of each request's modality.

    ``requests(query_id, query_text, query_image, image_vec, image_text_vec, sentence_vec)``;
    ``components`` are keyed text, image_vector and fusion_vector. The modality is derived
    once and drives both vector and weights; empty requests return nothing.
    """
    known = hybrid.detect_modality(requests).filter(F.col("modality").isNotNull())
    queries = fuse_query_embedding(known).withColumnRenamed("query_text", "text")
    weights = hybrid.modality_weights(queries)
    scored = None
    for name, component in components.items():
        mine = weights.filter(F.col("component") == name).select("query_id")
        part = component(queries.join(mine, "query_id", "left_semi"), catalog, k)
        part = part.select("query_id", F.lit(name).alias("component"), "pid", "score")
        scored = part if scored is None else scored.unionByName(part)
    return hybrid.rank_fused(hybrid.fuse_weighted(scored, weights), k)


def respond(
    queries: DataFrame,
    ranked: DataFrame,
    products: DataFrame,
    reply: Callable[[DataFrame], DataFrame] | None = None,
    k: int = TOP_K,
) -> DataFrame:
    """Hydrate, rerank by an external reply if there is one, and add facets and ``reasoning``.

    ``reply`` turns payload rows (query_id, payload, n_items) into (query_id, n_items, reply).
    It sees the queries with text only (all of them where ``queries`` has no ``query_text``)
    and the first ``RERANK_SHARE`` of the k results that were asked for.
    """
    # Top-k rows only, read by every branch below.
    results = pinned(facets.hydrate_results(ranked, products))
    window = int(RERANK_SHARE * k)
    has_text = F.coalesce(F.col("query_text") != "", F.lit(False)) if "query_text" in queries.columns else F.lit(True)
    asked = queries.select("query_id", has_text.alias("_text"))
    reasoning = asked.select("query_id", F.when(F.col("_text"), NO_MODEL).otherwise(IMAGE_ONLY).alias("reasoning"))
    if reply is not None:
        worded = results.join(asked.filter("_text"), "query_id", "left_semi")
        shown = worded.filter(F.col("rank") <= window).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_items"))
        parsed = pinned(rerank.rerank_parse_reply(reply(rerank.rerank_payload(worded, window).join(shown, "query_id"))))
        results = rerank.rerank_apply(results, parsed, window).drop("old_rank")
        said = parsed.select("query_id", F.col("reasoning").alias("_said"))
        reasoning = reasoning.join(said, "query_id", "left").select("query_id", F.coalesce("_said", "reasoning").alias("reasoning"))
    shares = {name: facets.facet_share(results, name) for name in ("category", "brand")}
    out = facets.search_response(queries, results, shares)
    return out.join(reasoning, "query_id", "left")
