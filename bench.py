"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.operators import hybrid, textstore, vectorstore  # noqa: E402
from shelfmark.registry import QUERIES  # noqa: E402
from shelfmark.registry import hybrid as registered  # noqa: E402
from shelfmark.registry.base import name_queries  # noqa: E402
from shelfmark.registry.vectors import seeds  # noqa: E402
from shelfmark.session import get_session, pinned  # noqa: E402

HEADLINE = [
    "clean_products", "invalid_value_report", "dedup_first", "chunk_assign", "hydrate_results",
    "text_index", "match_all_terms", "rank_frequency", "rank_cover_density", "text_topk",
    "knn_exact", "knn_exact_blocked", "ivf_assign", "ivf_search", "sq8_search", "verify_index", "sweep_configs",
    "encode_text", "hybrid_search", "rerank_apply", "search_response", "facet_share", "top_ngrams", "keyword_extract",
    "recall_breakdown", "feedback_fold", "feedback_stream",
]
# Search batches answer this many queries at once: seconds per query is the published unit.
PER_QUERY = {"text_topk": "part", "hybrid_search": "part", "ivf_search": "part", "search_response": "part"}


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def stored_index(spark, sf_dir: str) -> dict[str, float]:
    """Hybrid search over a stored index, without its build: seconds for all product names at once
    and for one name alone (the published unit is one query at a time), on all vectors and on
    the probed cells."""
    start = time.perf_counter()
    catalog = registered.catalog(spark, sf_dir)
    catalog.text = textstore.store_of(catalog.products, buckets=16)
    catalog.stores = {n: vectorstore.store_of(v, pinned(seeds(spark, sf_dir)), buckets=16) for n, v in catalog.vectors.items()}
    catalog.vectors = {n: s.cells.select("pid", "embedding") for n, s in catalog.stores.items()}
    out, names = {"build": round(time.perf_counter() - start, 3)}, pinned(name_queries(spark, sf_dir))
    one = pinned(names.limit(1))
    exact = hybrid.build_components(registered.CONFIG)
    clustered = [exact[0], hybrid.clustered_component("fusion_embedding", 4)]
    for label, parts, queries in (
        ("warm", exact, names), ("batch", exact, names), ("one_query", exact, one),
        ("warm", clustered, names), ("batch_clustered", clustered, names), ("one_query_clustered", clustered, one),
    ):
        start = time.perf_counter()
        hybrid.hybrid_search(queries, catalog, parts, [0.5, 0.5], registered.K).write.format("noop").mode("overwrite").save()
        out[label] = round(time.perf_counter() - start, 3)
    del out["warm"]
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    run(spark, "text_topk", sf_dir)  # JVM and Python workers warm up
    run(spark, "knn_exact", sf_dir)
    times = {name: run(spark, name, sf_dir) for name in names}
    stored = stored_index(spark, sf_dir)
    batch = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().count()
    per_query = {n: round(times[n] / batch, 4) for n in PER_QUERY if n in times}
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "batch_queries": batch,
                "sec_per_search": per_query,
                "stored_index": stored,
            }
        )
    )


if __name__ == "__main__":
    main()
