"""Weighted fusion of scored components."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ranking import normalize_top, score_key, top_k
from shelfmark.functions.parsing import is_blank
from shelfmark.operators import ivf, textsearch, textstore, vectorstore
from shelfmark.operators.vectors import knn_exact
from shelfmark.schema import COMPONENT_ORDER, MODALITY_WEIGHTS


# The component types and rank methods that a retrieval configuration names.
EXACT_VECTOR = "PostgresVectorRetrieval"
CLUSTERED_VECTOR = "FaissVectorRetrieval"
TEXT = "TextSearchRetrieval"
RANK_METHODS = {"ts_rank": textsearch.rank_frequency, "ts_rank_cd": textsearch.rank_cover_density}


@dataclass
class Catalog:
    """The tables a search reads: the stores of an index, or plain tables. Vector tables are per embedding type."""

    products: DataFrame | None = None
    text: textstore.TextStore | None = None
    stores: dict[str, vectorstore.VectorStore] | None = None
    postings: DataFrame | None = None
    term_stats: DataFrame | None = None
    vectors: dict[str, DataFrame] | None = None
    centroids: dict[str, DataFrame] | None = None
    cells: dict[str, DataFrame] | None = None


# (queries, catalog, k) -> scored rows (query_id, pid, score), best score 1
Component = Callable[[DataFrame, Catalog, int], DataFrame]


def vector_component(embedding_type: str) -> Component:
    def run(queries: DataFrame, catalog: Catalog, k: int) -> DataFrame:
        return knn_exact(queries, catalog.vectors[embedding_type], k).drop("rank")

    return run


def clustered_component(embedding_type: str, nprobe: int = 1) -> Component:
    def run(queries: DataFrame, catalog: Catalog, k: int) -> DataFrame:
        if catalog.stores is not None:
            found = vectorstore.search(catalog.stores[embedding_type], queries, k, nprobe)
            return normalize_top(found.select("query_id", "pid", F.col("cosine").alias("score")).filter(F.col("score").isNotNull()), style="vector")
        found = ivf.ivf_search(
            queries, catalog.centroids[embedding_type], catalog.cells[embedding_type], k, nprobe
        )
        return ivf.search_rescored(found, queries, catalog.vectors[embedding_type])

    return run


def text_component(method: str) -> Component:
    ranker = RANK_METHODS.get(method)
    if ranker is None:
        raise ValueError(f"unknown rank method: {method}")

    def run(queries: DataFrame, catalog: Catalog, k: int) -> DataFrame:
        if catalog.text is not None:
            found = textstore.search(catalog.text, queries, k, textstore.RANKERS[method])
            return normalize_top(found, style="text").drop("rank")
        parsed = textsearch.parse_queries(queries)
        scored = ranker(catalog.postings, parsed, catalog.term_stats)
        return textsearch.text_topk(scored, k).drop("rank")

    return run


def build_component(config: dict) -> Component:
    """A component from ``{"type": ..., "params": {...}}``; an unknown type is an error."""
    kind, params = config["type"], config.get("params", {})
    if kind == EXACT_VECTOR:
        return vector_component(params["column_name"])
    if kind == CLUSTERED_VECTOR:
        return clustered_component(params["column_name"], int(params.get("nprobe", 1)))
    if kind == TEXT:
        return text_component(params["rank_method"])
    raise ValueError(f"unknown component type: {kind}")


def build_components(configs: Sequence[dict]) -> list[Component]:
    return [build_component(c) for c in configs]


def prune_zero_weight(components: Sequence, weights: Sequence[float]) -> list[tuple]:
    """Pairs of positive weight; the rest never enter the plan."""
    return [(c, w) for c, w in zip(components, weights) if w > 0]


def weight_expression(modality):
    """(component, weight) entries of positive weight for a modality column."""
    chosen = None
    for name, weights in MODALITY_WEIGHTS.items():
        entries = [
            F.struct(F.lit(c).alias("component"), F.lit(float(w)).alias("weight"))
            for c, w in zip(COMPONENT_ORDER, weights)
            if w > 0
        ]
        chosen = (F if chosen is None else chosen).when(modality == name, F.array(*entries))
    return chosen


def modality_weights(queries: DataFrame) -> DataFrame:
    """(query_id, component, weight) rows with weight > 0."""
    entries = F.explode(weight_expression(F.col("modality"))).alias("_w")
    return queries.select("query_id", entries).select("query_id", "_w.component", "_w.weight")


def detect_modality(requests: DataFrame) -> DataFrame:
    """Modality from what a request holds; NULL means it holds nothing and is rejected."""
    has_text, has_image = ~is_blank(F.col("query_text")), F.col("query_image").isNotNull()
    return requests.withColumn(
        "modality",
        F.when(has_text & has_image, "multimodal").when(has_image, "image").when(has_text, "text"),
    )


def fuse_full_outer(scored: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Union of components with absent = 0, as one grouping instead of an n-way outer join."""
    parts = [d.select("query_id", "pid", (F.col("score") * float(w)).alias("score")) for d, w in scored]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("query_id", "pid").agg(F.sum("score").alias("score"))


def fuse_weighted(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """The same with weights per query: ``scored(query_id, component, pid, score)``."""
    active = weights.filter(F.col("weight") > 0)
    joined = scored.join(active, ["query_id", "component"])
    return joined.groupBy("query_id", "pid").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))


def rank_fused(fused: DataFrame, k: int) -> DataFrame:
    """Ranks decided on the rounded score, where exact ties are common."""
    return top_k(fused.withColumn("score", score_key("score")), k)


def hybrid_search(
    queries: DataFrame, catalog: Catalog, components: Sequence[Component], weights: Sequence[float], k: int
) -> DataFrame:
    """Top-k by weighted sum of the components' own top-k. Returns query_id, pid, score, rank."""
    active = prune_zero_weight(components, weights)
    if not active:
        empty = queries.select("query_id", F.lit(None).cast("bigint").alias("pid"), F.lit(0.0).alias("score"))
        return empty.withColumn("rank", F.lit(0)).limit(0)
    return rank_fused(fuse_full_outer([(c(queries, catalog, k), w) for c, w in active]), k)
