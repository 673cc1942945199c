"""Fusion and rerank queries over product names, product vectors and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import hybrid, rerank, textsearch
from shelfmark.registry.base import (
    NAME_QUERIES,
    PRODUCTS,
    VECTORS,
    name_queries,
    products,
    query,
    ranked_sql,
    search_sql,
    table,
    vectors,
)
from shelfmark.registry.ids import SCORED, scored_events
from shelfmark.registry.text import FREQUENCY
from shelfmark.session import pinned, staged

K = 40
CONFIG = [
    {"type": "TextSearchRetrieval", "params": {"rank_method": "ts_rank"}},
    {"type": "PostgresVectorRetrieval", "params": {"column_name": "fusion_embedding"}},
]


def catalog(spark, sf_dir) -> hybrid.Catalog:
    goods = products(spark, sf_dir)
    return hybrid.Catalog(
        products=goods,
        postings=staged(textsearch.text_index(goods), "postings"),
        vectors={"fusion_embedding": vectors(spark, sf_dir).select("pid", "embedding")},
    )


NORMALIZED = """SELECT query_id, pid, CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 0
    ELSE score / max(score) OVER (PARTITION BY query_id) END AS score FROM {source}"""
HYBRID = f"""WITH products AS ({PRODUCTS}), {NAME_QUERIES}, {VECTORS},
    {search_sql('products', 'name_queries')},
    freq AS ({FREQUENCY.replace('round(', '(').replace(', 6) AS score', ') AS score')}),
    cosines AS (SELECT query_id, pid, list_cosine_similarity(q.embedding, v.v) AS score FROM name_queries q, vectors v),
    text_part AS ({NORMALIZED.format(source='(' + ranked_sql('freq', K) + ')')}),
    vector_part AS ({NORMALIZED.format(source='(' + ranked_sql('cosines', K) + ')')}),
    fused AS (SELECT query_id, pid, round(sum(0.5 * score), 6) AS score FROM (FROM text_part UNION ALL FROM vector_part) GROUP BY 1, 2),
    ranked AS ({ranked_sql('fused', K)})"""


def hybrid_results(spark, sf_dir):
    parts = hybrid.build_components(CONFIG)
    return hybrid.hybrid_search(pinned(name_queries(spark, sf_dir)), catalog(spark, sf_dir), parts, [0.5, 0.5], K)


@query("hybrid_search", f"{HYBRID} SELECT query_id, pid, score, CAST(rank AS INTEGER) AS rank FROM ranked")
def hybrid_search(spark, sf_dir):
    return hybrid_results(spark, sf_dir)


@query(
    "build_components",
    f"{HYBRID}, ranked_text AS ({ranked_sql('text_part', K)}) SELECT query_id, pid, round(score, 6) AS score FROM ranked_text",
)
def build_components(spark, sf_dir):
    """One component alone, built from its configuration."""
    component = hybrid.build_component(CONFIG[0])
    return component(name_queries(spark, sf_dir), catalog(spark, sf_dir), K).withColumn("score", F.round("score", 6))


MODALITY = """requests AS (SELECT event_id AS query_id, CASE WHEN event_type = 'view' THEN 'text'
    WHEN event_type = 'click' THEN 'image' ELSE 'multimodal' END AS modality FROM events)"""
WEIGHTS = """w(modality, component, weight) AS (VALUES ('text', 'text', 0.5::DOUBLE), ('text', 'fusion_vector', 0.5), ('image', 'image_vector', 1.0),
    ('multimodal', 'text', 0.5), ('multimodal', 'fusion_vector', 0.5))"""


@query("modality_weights", f"WITH {MODALITY}, {WEIGHTS} SELECT query_id, component, weight FROM requests JOIN w USING (modality)")
def modality_weights(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "image").otherwise("multimodal")
    return hybrid.modality_weights(table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), kind.alias("modality")))


@query(
    "prune_zero_weight",
    f"""WITH s AS ({SCORED}), w(component, weight) AS (VALUES ('click', 0.7::DOUBLE), ('purchase', 0.3), ('view', 0.0)),
    f AS (SELECT query_id, pid, round(sum(score * weight), 6) AS score FROM s JOIN w USING (component) WHERE weight > 0 GROUP BY 1, 2)
    SELECT query_id, pid, score, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql('f', 10)})""",
)
def prune_zero_weight(spark, sf_dir):
    scored = scored_events(spark, sf_dir)
    names, weights = ["click", "purchase", "view"], [0.7, 0.3, 0.0]
    active = hybrid.prune_zero_weight(names, weights)
    fused = hybrid.fuse_full_outer([(scored.filter(F.col("component") == n), w) for n, w in active])
    return hybrid.rank_fused(fused, 10)


# --- rerank: hydrated hybrid results and made-up model replies -------------------------

RESULTS = f"""{HYBRID}, results AS (SELECT query_id, ranked.pid, CAST(rank AS INTEGER) AS rank, score, name, brand, category, size, price
    FROM ranked JOIN products USING (pid)),
    shown AS (SELECT query_id, CAST(count(*) AS INTEGER) AS n_items, any_value(length(query_id)) AS l FROM results WHERE rank <= 30 GROUP BY 1)"""


def results(spark, sf_dir):
    found = hybrid_results(spark, sf_dir).join(products(spark, sf_dir).drop("document"), "pid")
    return pinned(found)


# Replies of every kind a model gives, by the length of the query text.
REPLY = """CASE length(query_id) % 5
    WHEN 0 THEN 'Sure. {"reordered_indices": [2, 0, 1, 2], "reasoning": "names"} Done.'
    WHEN 1 THEN '{"reordered_indices": [4, 3], "reasoning": "price"}'
    WHEN 2 THEN 'no list today'
    WHEN 3 THEN '{"reordered_indices": [1, 99], "reasoning": "made up"}'
    ELSE '{"reasoning": "as it was"}' END"""
REPLIES = f"""{RESULTS}, replies AS (SELECT query_id, n_items, {REPLY} AS reply FROM shown),
    parsed AS (SELECT query_id, n_items, CASE length(query_id) % 5 WHEN 0 THEN [2, 0, 1, 2] WHEN 1 THEN [4, 3] WHEN 3 THEN [1, 99]
      ELSE range(n_items) END AS indices,
      CASE length(query_id) % 5 WHEN 0 THEN 'names' WHEN 1 THEN 'price' WHEN 2 THEN reply WHEN 3 THEN 'made up' ELSE 'as it was' END AS reasoning FROM replies)"""


def replies(spark, sf_dir):
    return replies_to(results(spark, sf_dir))


def replies_to(found):
    shown = found.filter(F.col("rank") <= 30).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_items"))
    return shown.withColumn("reply", F.expr(REPLY))


def joined(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(
    "rerank_payload",
    f"""{RESULTS} SELECT query_id, string_agg(concat_ws('|', CAST(rank - 1 AS VARCHAR), name, brand, category, size), ';' ORDER BY rank) AS items
    FROM results WHERE rank <= 30 GROUP BY 1""",
)
def rerank_payload(spark, sf_dir):
    """The JSON text per query, read back field by field."""
    payload = rerank.rerank_payload(results(spark, sf_dir).withColumnsRenamed({"name": "Name", "brand": "Brand", "category": "Category", "size": "Size", "price": "Price"}))
    item = "array<struct<index: int, Name: string, Brand: string, Category: string, Size: string, Price: double>>"
    line = F.transform(F.from_json("payload", item), lambda i: F.concat_ws("|", i["index"].cast("string"), i["Name"], i["Brand"], i["Category"], i["Size"]))
    return payload.select("query_id", F.array_join(line, ";").alias("items"))


@query("rerank_parse_reply", f"{REPLIES} SELECT query_id, array_to_string(indices, ',') AS indices, reasoning FROM parsed")
def rerank_parse_reply(spark, sf_dir):
    return rerank.rerank_parse_reply(replies(spark, sf_dir)).select("query_id", joined("indices"), "reasoning")


@query(
    "rerank_audit",
    f"""{REPLIES} SELECT query_id,
      array_to_string(list_sort(list_filter(range(n_items), lambda i: NOT list_contains(indices, i))), ',') AS missing,
      array_to_string(list_sort(list_distinct(list_filter(indices, lambda i: i >= n_items))), ',') AS extra FROM parsed""",
)
def rerank_audit(spark, sf_dir):
    audit = rerank.rerank_audit(rerank.rerank_parse_reply(replies(spark, sf_dir)))
    return audit.select("query_id", joined("missing"), joined("extra"))


@query(
    "rerank_apply",
    f"""{REPLIES}, placed AS (SELECT r.*, CASE WHEN rank <= 30 AND list_max(indices) < (SELECT least(max(rank), 30) FROM results x WHERE x.query_id = r.query_id)
        AND list_contains(indices, rank - 1) THEN list_position(indices, rank - 1) ELSE 100 + rank END AS place
      FROM results r JOIN parsed p USING (query_id))
    SELECT query_id, pid, rank AS old_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, rank) AS INTEGER) AS rank FROM placed""",
)
def rerank_apply(spark, sf_dir):
    found = results(spark, sf_dir)
    orders = rerank.rerank_parse_reply(replies_to(found))
    return rerank.rerank_apply(found, orders).select("query_id", "pid", "old_rank", "rank")


@query(
    "rerank_rules",
    """WITH r AS (SELECT p.p_partkey AS pid, p_name AS name, p_brand AS brand, p_retailprice AS price, l_orderkey AS query_id,
        concat('cheap ', lower(p_brand), ' ring under $', CAST(l_orderkey % 7 + 900 AS VARCHAR)) AS q FROM lineitem JOIN part p ON l_partkey = p.p_partkey)
    SELECT query_id, pid, CAST(len(list_intersect(list_distinct(regexp_extract_all(q, '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')))) AS INTEGER) AS keyword_hits,
      contains(q, lower(brand)) AS brand_hit, price < CAST(regexp_extract(q, 'under \\$?([0-9]+)', 1) AS DOUBLE) AS price_ok FROM r""",
)
def rerank_rules(spark, sf_dir):
    goods = products(spark, sf_dir).select("pid", "name", "brand", "price")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("pid"))
    text = F.concat(F.lit("cheap "), F.lower("brand"), F.lit(" ring under $"), (F.col("query_id") % 7 + 900).cast("string"))
    asked = lines.join(goods, "pid").withColumn("query_text", text)
    return rerank.rerank_rules(asked).select("query_id", "pid", "keyword_hits", "brand_hit", "price_ok")


RULED = """WITH r AS (SELECT p.p_partkey AS pid, p_name AS name, p_brand AS brand, p_retailprice AS price, l_orderkey AS query_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank,
        concat('cheap ', CASE WHEN l_orderkey % 3 = 0 THEN lower(p_brand) ELSE '' END, ' ring', CASE WHEN l_orderkey % 2 = 0 THEN concat(' under $', CAST(l_orderkey % 700 + 900 AS VARCHAR)) ELSE '' END) AS q
      FROM lineitem JOIN part p ON l_partkey = p.p_partkey),
    s AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(q, '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')))) AS hits,
      contains(q, lower(brand)) AS brand_hit, coalesce(price < TRY_CAST(regexp_extract(q, 'under \\$?([0-9]+)', 1) AS DOUBLE), true) AS price_ok, rank <= 5 AS shown FROM r),
    t AS (SELECT *, rank + rank() OVER (PARTITION BY query_id, shown ORDER BY hits DESC) + rank() OVER (PARTITION BY query_id, shown ORDER BY brand_hit DESC)
      + rank() OVER (PARTITION BY query_id, shown ORDER BY price_ok DESC) AS total FROM s)
    SELECT query_id, pid, CAST(rank AS INTEGER) AS rank,
      CAST(CASE WHEN shown THEN row_number() OVER (PARTITION BY query_id, shown ORDER BY total, rank) ELSE rank END AS INTEGER) AS new_rank FROM t"""


@query("rerank_by_rules", RULED)
def rerank_by_rules(spark, sf_dir):
    """The lines of an order as the results of a query; the first five are put in order."""
    goods = products(spark, sf_dir).select("pid", "name", "brand", "price")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("pid"), F.col("l_linenumber").alias("at"))
    asked = lines.join(goods, "pid").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "pid")))
    brand = F.when(F.col("query_id") % 3 == 0, F.lower("brand")).otherwise("")
    limit = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit(" under $"), (F.col("query_id") % 700 + 900).cast("string"))).otherwise("")
    asked = asked.withColumn("query_text", F.concat(F.lit("cheap "), brand, F.lit(" ring"), limit))
    return rerank.rerank_by_rules(asked, 5).select("query_id", "pid", "rank", "new_rank")


@query(
    "retrieve_by_modality",
)
def retrieve_by_modality(spark, sf_dir):
    """The whole search plan on requests of all modalities."""
    from shelfmark.plans.search import respond, retrieve

    names = pinned(name_queries(spark, sf_dir))
    long_name = F.length("query_id") > 9
    requests = names.select(
        "query_id",
        F.when(F.length("query_id") > 8, F.col("text")).alias("query_text"),
        F.when(~long_name, F.lit("picture")).alias("query_image"),
        F.when(~long_name, F.col("embedding")).alias("image_vec"),
        F.col("embedding").alias("image_text_vec"),
        F.when(F.length("query_id") > 8, F.col("embedding")).alias("sentence_vec"),
    )
    both = catalog(spark, sf_dir)
    image = both.vectors["fusion_embedding"]
    both.vectors = {"image": image, "fusion": image.select("pid", F.concat("embedding", "embedding").alias("embedding"))}
    components = {
        "text": hybrid.text_component("ts_rank"),
        "image_vector": hybrid.vector_component("image"),
        "fusion_vector": hybrid.vector_component("fusion"),
    }
    ranked = retrieve(requests, both, components, K)
    out = respond(names.select("query_id"), ranked, both.products.drop("document"))
    return out.select("query_id", F.size("results").alias("n_results"), "min_price", "max_price", "avg_price")
