"""Evaluation queries: three phrasings of every benchmark passage against the documents,
and ratings of every session."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.functions.ranking import top_k
from shelfmark.operators import evaluate, textsearch
from shelfmark.operators.ids import hit_test
from shelfmark.registry.base import DOCUMENTS, derived, documents, query, ranked_sql, search_sql, table
from shelfmark.session import staged

# Phrasings: long words only, medium words, the whole passage.
PHRASED = """phrased AS (SELECT item_id, text AS natural_query,
    array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 8), ' ') AS basic_query,
    array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 5), ' ') AS attribute_query
    FROM benchmark)"""
LONG = """long AS (
    SELECT item_id, 'basic_query' AS query_type, basic_query AS query FROM phrased UNION ALL
    SELECT item_id, 'attribute_query', attribute_query FROM phrased UNION ALL
    SELECT item_id, 'natural_query', natural_query FROM phrased)"""


def phrased(spark, sf_dir):
    def long_words(least: int):
        return F.array_join(F.filter(X.words(F.col("text")), lambda w: F.length(w) >= least), " ")

    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("natural_query"), long_words(8).alias("basic_query"), long_words(5).alias("attribute_query")
    )


@query("unpivot_queries", f"WITH {PHRASED}, {LONG} SELECT item_id, query_type, query FROM long")
def unpivot_queries(spark, sf_dir):
    return evaluate.unpivot_queries(phrased(spark, sf_dir), ["item_id"])


# The target of a passage is the first document that holds it word for word; a passage
# in no document has none and counts as a miss. Its category is the document's source.
SEARCHES = f"""WITH {PHRASED}, {LONG},
    target AS (SELECT item_id, min(doc_id) AS target FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
    queries AS (SELECT concat(query_type, '/', CAST(item_id AS VARCHAR)) AS query_id, item_id, query_type, query AS text FROM long),
    {search_sql(DOCUMENTS, 'queries')},
    freq AS (SELECT query_id, pid, sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) / any_value(n) AS score FROM matched GROUP BY 1, 2),
    ranked AS ({ranked_sql('freq', 40)}),
    tested AS (SELECT q.query_id, q.query_type, CASE WHEN item_id % 3 = 0 THEN 'long' ELSE 'short' END AS category, t.target, r.rank IS NOT NULL AS hit
      FROM queries q JOIN (SELECT item_id AS i, coalesce(target, -1) AS target FROM benchmark LEFT JOIN target USING (item_id)) t ON t.i = q.item_id
      LEFT JOIN ranked r ON r.query_id = q.query_id AND r.pid = t.target)"""


def tested(spark, sf_dir, k=40):
    long = evaluate.unpivot_queries(phrased(spark, sf_dir), ["item_id"])
    queries = long.select(
        F.concat("query_type", F.lit("/"), F.col("item_id").cast("string")).alias("query_id"), "item_id", "query_type", F.col("query").alias("text")
    )
    postings = staged(textsearch.text_index(documents(spark, sf_dir)), "postings")
    found = top_k(textsearch.rank_frequency(postings, textsearch.parse_queries(queries)), k)
    # A document that holds a passage word for word also holds all of its words, so only
    # the pairs of the all-terms match are compared as text.
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    pairs = textsearch.match_all_terms(postings, textsearch.parse_queries(passages)).select("query_id", "pid")
    targets = (
        pairs.join(passages, "query_id")
        .join(documents(spark, sf_dir), "pid")
        .filter(F.contains("document", "text"))
        .groupBy(F.col("query_id").alias("item_id"))
        .agg(F.min("pid").alias("target"))
    )
    asked = queries.join(targets, "item_id", "left").select(
        "query_id",
        "query_type",
        F.when(F.col("item_id") % 3 == 0, "long").otherwise("short").alias("category"),
        F.coalesce("target", F.lit(-1)).alias("target"),
    )
    return hit_test(asked, found, k)


@query(
    "recall_at_k",
    f"""{SEARCHES} SELECT query_type, count(*) AS queries, CAST(round(CAST(avg(CAST(hit AS INTEGER)) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS recall FROM tested
    GROUP BY GROUPING SETS ((), (query_type))""",
)
def recall_at_k(spark, sf_dir):
    return evaluate.recall_at_k(tested(spark, sf_dir))


@query(
    "recall_breakdown",
    f"""{SEARCHES} SELECT category, query_type, CAST(grouping_id(category, query_type) AS INTEGER) AS level, count(*) AS queries,
    CAST(round(CAST(avg(CAST(hit AS INTEGER)) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS recall FROM tested GROUP BY GROUPING SETS ((), (query_type), (category, query_type))""",
)
def recall_breakdown(spark, sf_dir):
    return evaluate.recall_breakdown(tested(spark, sf_dir))


# Judged result lists: each source asks for its documents by length; the quality label says
# whether a document is relevant.
JUDGED = """judged AS (SELECT source AS query_id, doc_id AS pid, lang AS query_type,
      row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"""


@query(
    "precision_at_k",
    f"""WITH {JUDGED} SELECT query_id, round(count(*) FILTER (WHERE quality = 1) / 20.0::DOUBLE, 6) AS precision
    FROM judged JOIN labels ON doc_id = pid WHERE rank <= 20 GROUP BY 1""",
)
def precision_at_k(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("pid"), F.col("n_chars").cast("double").alias("score")
    )
    judgements = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pid"), (F.col("quality") == 1).alias("relevant"))
    return evaluate.precision_at_k(top_k(listed, 20), judgements, 20).withColumn("precision", F.round("precision", 6))


RATED = """rated AS (SELECT event_type AS query_type, user_id AS query, count(*) AS total_results,
    count(*) FILTER (WHERE value < 5) AS negative FROM events GROUP BY 1, 2),
    precisions AS (SELECT query_type, query, (total_results - negative) / 20.0::DOUBLE AS precision FROM rated)"""


def precisions(spark, sf_dir):
    rated = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("query_type"), F.col("user_id").alias("query")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 5).alias("negative")
    )
    return rated.select("query_type", "query", ((F.col("total") - F.col("negative")) / 20).alias("precision"))


@query("mean_by_type", f"WITH {RATED} SELECT query_type, round(avg(precision), 6) AS mean_precision FROM precisions GROUP BY 1")
def mean_by_type(spark, sf_dir):
    return evaluate.mean_by_type(precisions(spark, sf_dir)).withColumn("mean_precision", F.round("mean_precision", 6))


RUNS = """SELECT o_orderkey AS run, concat(CAST(o_custkey % 100 AS STRING), CASE WHEN o_orderstatus = 'P' THEN 'min' ELSE '.5min' END) AS duration FROM orders"""


@query("duration_parse", f"WITH runs AS ({RUNS}) SELECT run, duration, round(CAST(replace(duration, 'min', '') AS DOUBLE) * 60 / 300, 6) AS search_time FROM runs")
def duration_parse(spark, sf_dir):
    return evaluate.duration_parse(derived(spark, sf_dir, RUNS, "orders")).withColumn("search_time", F.round("search_time", 6))


@query(
    "metric_summary",
    f"""WITH {RATED}, recalls AS (SELECT concat('m', CAST(user_id % 3 AS VARCHAR)) AS method, event_type AS query_type, round(avg(CASE WHEN value > 5 THEN 1 ELSE 0 END), 6) AS recall FROM events GROUP BY 1, 2),
    means AS (SELECT concat('m', CAST(query % 3 AS VARCHAR)) AS method, query_type, avg(precision) AS precision FROM precisions GROUP BY 1, 2),
    times AS (SELECT concat('m', CAST(o_custkey % 3 AS VARCHAR)) AS method, round(max(o_custkey % 100) * 60 / 300.0::DOUBLE, 6) AS search_time FROM orders GROUP BY 1)
    SELECT method, query_type, recall, CAST(round(CAST(precision AS DECIMAL(18, 6)), 2) AS DOUBLE) AS precision, search_time FROM recalls LEFT JOIN means USING (method, query_type) LEFT JOIN times USING (method)""",
)
def metric_summary(spark, sf_dir):
    def method(key: str):
        return F.concat(F.lit("m"), (F.col(key) % 3).cast("string")).alias("method")

    recalls = table(spark, sf_dir, "events").groupBy(method("user_id"), F.col("event_type").alias("query_type")).agg(
        F.round(F.avg((F.col("value") > 5).cast("int")), 6).alias("recall")
    )
    means = precisions(spark, sf_dir).groupBy(method("query"), "query_type").agg(F.avg("precision").alias("precision"))
    runs = table(spark, sf_dir, "orders").groupBy(method("o_custkey")).agg(F.concat(F.max(F.col("o_custkey") % 100).cast("string"), F.lit("min")).alias("duration"))
    times = evaluate.duration_parse(runs).select("method", F.round("search_time", 6).alias("search_time"))
    return evaluate.metric_summary(recalls, means, times)
