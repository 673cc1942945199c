"""Registered queries against DuckDB. All of them with SHELFMARK_ALL=1, else a cross-section."""

import os

import pytest

from shelfmark.registry import ORACLES, QUERIES
from tools.check_oracle import compare, connect

CROSS_SECTION = [
    "clean_products", "invalid_value_report", "attach_embeddings", "dedup_first", "append_new_vectors", "chunk_assign",
    "chunk_gap_report", "fuse_full_outer", "hit_test", "fuse_query_embedding", "encode_text", "knn_exact",
    "knn_exact_blocked", "ivf_search", "ivf_refine", "sq8_search", "verify_index", "ivf_recall", "text_index",
    "rank_cover_density", "rank_tfidf", "text_topk", "hybrid_search", "rerank_apply", "facet_share", "category_rollup",
    "top_ngrams", "extract_tags", "recall_breakdown", "feedback_fold", "scan_products_csv", "keyword_extract", "feedback_late",
    "text_store_append", "text_store_cover", "ivf_sq8_search", "stem_english", "rerank_by_rules", "index_append",
]
NAMES = sorted(ORACLES) if os.environ.get("SHELFMARK_ALL") else CROSS_SECTION


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, data, name):
    verdict, _ = compare(spark, duck, data, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    out = contract.entry(spark)
    assert out.count() > 0 and {"query_id", "rank", "pid", "score", "name"} <= set(out.columns)
