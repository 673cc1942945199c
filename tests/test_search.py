import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.ranking import max_normalize
from shelfmark.operators import facets, hybrid, rerank, textsearch
from shelfmark.plans import evaluation, index_build, search


def test_weighted_fusion(spark):
    schema = "query_id int, pid string, score double"
    vec = spark.createDataFrame([(1, "lamp", 0.8), (1, "desk", 0.5)], schema)
    text = spark.createDataFrame([(1, "desk", 1.0), (1, "shelf", 0.4)], schema)
    queries = spark.createDataFrame([(1,)], "query_id int")

    def fails(*_):
        raise AssertionError("a component of weight 0 must not run")

    parts = [lambda *_: vec, lambda *_: text, fails]
    got = hybrid.hybrid_search(queries, hybrid.Catalog(), parts, [0.7, 0.3, 0.0], 3).orderBy("rank").collect()
    # desk 0.35 + 0.3, lamp 0.56, shelf 0.12
    assert [(r["pid"], r["score"]) for r in got] == [("desk", 0.65), ("lamp", 0.56), ("shelf", 0.12)]
    alone = hybrid.hybrid_search(queries, hybrid.Catalog(), parts, [1.0, 0.0, 0.0], 3).orderBy("rank").collect()
    assert [(r["pid"], r["score"]) for r in alone] == [("lamp", 0.8), ("desk", 0.5)]
    assert hybrid.hybrid_search(queries, hybrid.Catalog(), parts, [0, 0, 0], 3).count() == 0


def test_unknown_component():
    with pytest.raises(ValueError):
        hybrid.build_component({"type": "Nope", "params": {}})
    with pytest.raises(ValueError):
        hybrid.build_component({"type": "TextSearchRetrieval", "params": {"rank_method": "bm25"}})


def test_normalisation_styles(spark):
    df = spark.createDataFrame([(1, 1, -2.0), (1, 2, -4.0), (2, 1, 0.0), (3, 1, 2.0), (3, 2, 1.0)], "query_id int, pid int, score double")
    got = {s: [r["score"] for r in max_normalize(df, style=s).orderBy("query_id", "pid").collect()] for s in ("vector", "text")}
    assert got == {"vector": [-2.0, -4.0, 0.0, 1.0, 0.5], "text": [1.0, 2.0, 0.0, 1.0, 0.5]}


def test_modality(spark):
    df = spark.createDataFrame([("a", "i"), (" ", "i"), ("a", None), ("", None)], "query_text string, query_image string")
    assert [r["modality"] for r in hybrid.detect_modality(df).collect()] == ["multimodal", "image", "text", None]


@pytest.fixture
def results(spark):
    return spark.createDataFrame([(1, i + 1, "abc"[i], f"n{i + 1}") for i in range(3)], "query_id int, rank int, pid string, Name string")


def order(spark, results, indices, window=30):
    orders = spark.createDataFrame([(1, indices)], "query_id int, indices array<int>")
    return [r["pid"] for r in rerank.rerank_apply(results, orders, window).orderBy("rank").collect()]


def test_rerank(spark, results):
    for indices, window, want in (
        ([1, 2, 0], 30, "bca"), ([0, 1, 2], 30, "abc"), ([2, 2], 30, "cab"), ([1, 0, 9], 30, "abc"),
        ([1, -4], 30, "abc"), ([1], 2, "bac"), ([2], 2, "abc"),
    ):
        assert "".join(order(spark, results, indices, window)) == want


def test_rerank_texts(spark, results):
    shown = json.loads(rerank.rerank_payload(results).first()["payload"])
    assert shown[0] == {"index": 0, "Name": "n1"} and len(shown) == 3
    texts = [
        (1, 3, 'ok {"reordered_indices": [2, 0], "reasoning": "r"}.'),
        (2, 3, "none"),
        (3, 3, '{"reasoning": "x"}'),
        (4, 2, "{broken"),
        (5, 2, '{"reordered_indices": [0, 7]}'),
    ]
    parsed = rerank.rerank_parse_reply(spark.createDataFrame(texts, "query_id int, n_items int, reply string"))
    got = {r["query_id"]: (r["indices"], r["reasoning"]) for r in parsed.collect()}
    assert got == {
        1: ([2, 0], "r"),
        2: ([0, 1, 2], "none"),
        3: ([0, 1, 2], "x"),
        4: ([0, 1], "{broken"),
        5: ([0, 7], "No reasoning provided"),
    }
    audit = {r["query_id"]: (r["missing"], r["extra"]) for r in rerank.rerank_audit(parsed).collect()}
    assert audit[1] == ([1], []) and audit[5] == ([1], [7])


def test_lookup_and_facets(spark):
    goods = spark.createDataFrame([("101", "a", 5.0), ("102", "b", None), ("it's", "c", 1.0)], "pid string, name string, price double")
    ranked = spark.createDataFrame([(1, 1, "200"), (1, 2, "102"), (1, 3, "101"), (1, 4, "it's")], "query_id int, rank int, pid string")
    got = facets.hydrate_results(ranked, goods).orderBy("rank").collect()
    assert [(r["rank"], r["pid"], r["price"]) for r in got] == [(2, "102", None), (3, "101", 5.0), (4, "it's", 1.0)]
    assert facets.fetch_by_pids(goods, ranked.unionByName(ranked)).count() == 3
    rows = [(1, "A > x", i) for i in range(1)] + [(1, "A > y", i) for i in range(2)] + [(1, None, i) for i in range(5)]
    shares = facets.facet_share(spark.createDataFrame(rows, "query_id int, category string, pid int"), "category")
    # 12.5 rounds to 12, 62.5 to 62: half to even.
    assert {r["value"]: r["share"] for r in shares.collect()} == {"A > x": 12, "A > y": 25, "None": 62}
    assert {r["category"]: r["share"] for r in facets.category_rollup(shares).collect()} == {"A": 37, "None": 62}
    assert [r["value"] for r in facets.top_brands(shares, 2).orderBy("rank").collect()] == ["None", "A > y"]
    pages = spark.createDataFrame([(1, r, r) for r in range(1, 46)], "query_id int, rank int, pid int")
    assert [facets.paginate(pages, p).count() for p in (1, 2, 3, 4)] == [20, 20, 5, 0]


def test_whole_flow(spark, data, tmp_path):
    from shelfmark.registry.base import name_queries, raw_products, vectors

    v = vectors(spark, data).select(F.concat(F.lit("P"), F.col("pid").cast("string")).alias("pid"), F.lit("fusion").alias("embedding_type"), "embedding")
    index_build.write_index(raw_products(spark, data).drop("row_no"), v, str(tmp_path), 8, buckets=4)
    catalog = index_build.read_index(spark, str(tmp_path))
    queries = name_queries(spark, data)
    parts = [hybrid.text_component("ts_rank_cd"), hybrid.clustered_component("fusion", 8)]
    ranked = hybrid.hybrid_search(queries, catalog, parts, [0.5, 0.5], 40)
    goods = catalog.products.select(
        F.col("Pid").alias("pid"), F.col("Name").alias("name"), F.col("MergedBrand").alias("brand"), F.col("Category").alias("category"), F.col("Price").alias("price")
    )

    def reply(payloads):
        return payloads.select("query_id", "n_items", F.lit('{"reordered_indices": [1, 0], "reasoning": "swap"}').alias("reply"))

    out = search.respond(queries.select("query_id"), ranked, goods, reply).collect()
    assert len(out) == queries.count()
    full = [r for r in out if len(r["results"]) > 1]
    assert full and all(r["reasoning"] == "swap" and r["category_distribution"] for r in full)
    mixed = queries.select("query_id", F.when(F.length("query_id") > 9, "words").alias("query_text"))
    told = search.respond(mixed, ranked, goods, reply).collect()
    assert {(r["query_text"] is None, r["reasoning"]) for r in told if len(r["results"]) > 1} == {(False, "swap"), (True, "Image search only, no LLM reordering performed")}
    assert any(not r["results"] for r in search.respond(spark.createDataFrame([("nobody",)], "query_id string"), ranked, goods).collect())

    asked = queries.withColumns({"query_type": F.lit("basic_query"), "category": F.lit("all"), "target": F.lit("P1")})
    configs = [
        {"name": "text", "components": [{"type": "TextSearchRetrieval", "params": {"rank_method": "ts_rank"}}], "weights": [1.0]},
        {"name": "exact", "components": [{"type": "PostgresVectorRetrieval", "params": {"column_name": "fusion"}}], "weights": [1.0]},
    ]
    recall = evaluation.run_benchmark(asked, catalog, configs, 40).collect()
    assert {r["config"] for r in recall} == {"text", "exact"} and all(0 <= r["recall"] <= 1 for r in recall)


def test_order_from_the_hints(spark):
    rows = [
        (1, 1, "plain chair", "Acme", 50.0), (1, 2, "red lamp", "Lumo", 90.0), (1, 3, "red lamp shade", "Acme", 20.0), (1, 4, "red lamp", "Lumo", 10.0),
        (2, 1, "b", "x", 1.0), (2, 2, "a", "y", None),
    ]
    df = spark.createDataFrame(rows, "query_id int, rank int, name string, brand string, price double")
    df = df.withColumn("query_text", F.when(F.col("query_id") == 1, "red lamp by lumo under $60").otherwise("nothing"))
    got = {(r.query_id, r.rank): r.new_rank for r in rerank.rerank_by_rules(df).collect()}
    # Places by words 4 1 1 1, brand 3 1 3 1, price 1 4 1 1 and rank: 9, 8, 8, 7.
    assert got == {(1, 1): 4, (1, 2): 2, (1, 3): 3, (1, 4): 1, (2, 1): 1, (2, 2): 2}
    got = {(r.query_id, r.rank): r.new_rank for r in rerank.rerank_by_rules(df, 2).collect()}
    assert (got[1, 3], got[1, 4]) == (3, 4)  # beyond the window
