"""Join and id-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.vectors import as_double
from shelfmark.operators import facets, hybrid, ids
from shelfmark.registry.base import products, query, table, vectors

# Two embedding types of different reach: `image` for all vectors, `text` for those that
# the labels table does not call toxic.
TYPED = """typed AS (
  SELECT vec_id AS pid, 'image' AS embedding_type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  UNION ALL
  SELECT vec_id, 'text', CAST(embedding AS DOUBLE[]) FROM embeddings
  WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def typed_embeddings(spark, sf_dir):
    all_of_them = vectors(spark, sf_dir).select("pid", "embedding")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("pid"))
    return all_of_them.withColumn("embedding_type", F.lit("image")).unionByName(
        all_of_them.join(toxic, "pid", "left_anti").withColumn("embedding_type", F.lit("text"))
    )


@query(
    "intersect_ids",
    f"""WITH {TYPED} SELECT p_partkey AS pid FROM part
    INTERSECT SELECT pid FROM typed WHERE embedding_type = 'image'
    INTERSECT SELECT pid FROM typed WHERE embedding_type = 'text'""",
)
def intersect_ids(spark, sf_dir):
    return ids.intersect_ids(products(spark, sf_dir), typed_embeddings(spark, sf_dir))


@query(
    "attach_embeddings",
    f"""WITH {TYPED} SELECT p_partkey AS pid, p_name AS name,
      CAST(len(i.v) AS INTEGER) AS image_dim, round(list_sum(i.v), 6) AS image_sum,
      CAST(len(t.v) AS INTEGER) AS text_dim, round(list_sum(t.v), 6) AS text_sum
    FROM part LEFT JOIN typed i ON i.pid = p_partkey AND i.embedding_type = 'image'
    LEFT JOIN typed t ON t.pid = p_partkey AND t.embedding_type = 'text'""",
)
def attach_embeddings(spark, sf_dir):
    wide = ids.attach_embeddings(products(spark, sf_dir), typed_embeddings(spark, sf_dir), ["image", "text"])

    def total(c):
        return F.round(F.aggregate(as_double(F.col(c)), F.lit(0.0), lambda a, x: a + x), 6)

    def dim(c):
        return F.when(F.col(c).isNotNull(), F.size(c))

    return wide.select(
        "pid",
        "name",
        dim("image_embedding").alias("image_dim"),
        total("image_embedding").alias("image_sum"),
        dim("text_embedding").alias("text_dim"),
        total("text_embedding").alias("text_sum"),
    )


@query(
    "dedup_first",
    """SELECT l_partkey AS pid, l_orderkey, l_linenumber FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1""",
)
def dedup_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pid"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("at")
    )
    return ids.dedup_first(lines, "at").select("pid", "at.l_orderkey", "at.l_linenumber")


@query(
    "insert_if_absent",
    """WITH old AS (SELECT p_partkey AS pid, p_retailprice AS price FROM part WHERE p_size < 25),
    new AS (SELECT l_partkey AS pid, min(l_extendedprice) AS price FROM lineitem GROUP BY 1)
    SELECT pid, price FROM old UNION ALL SELECT pid, price FROM new WHERE pid NOT IN (SELECT pid FROM old)""",
)
def insert_if_absent(spark, sf_dir):
    old = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("pid"), F.col("p_retailprice").alias("price"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"), F.col("l_extendedprice").alias("price"))
    return ids.insert_if_absent(old, new, "price")


@query(
    "append_new_vectors",
    """WITH old AS (SELECT vec_id AS pid, row_number() OVER (ORDER BY vec_id) - 1 AS vector_id FROM embeddings),
    new AS (SELECT DISTINCT p_partkey AS pid FROM part WHERE p_partkey NOT IN (SELECT pid FROM old))
    SELECT pid, (SELECT max(vector_id) FROM old) + row_number() OVER (ORDER BY pid) AS vector_id FROM new""",
)
def append_new_vectors(spark, sf_dir):
    index = ids.id_mapping(vectors(spark, sf_dir).withColumn("at", F.col("pid")), "at")
    return ids.append_new_ids(index, products(spark, sf_dir))


@query(
    "id_mapping",
    """SELECT l_partkey AS pid, max(n) - 1 AS vector_id FROM (
      SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) GROUP BY 1""",
)
def id_mapping(spark, sf_dir):
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"), order.alias("at"))
    return ids.id_mapping(lines, "at")


@query("chunk_assign", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS INTEGER) AS chunk FROM orders")
def chunk_assign(spark, sf_dir):
    return ids.chunk_assign(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(
    "chunk_gap_report",
    """WITH present AS (SELECT DISTINCT l_returnflag AS embedding_type, CAST(l_quantity AS INTEGER) AS chunk FROM lineitem
      UNION SELECT DISTINCT p_type, p_size * 2 FROM part),
    counts AS (SELECT embedding_type, count(*) AS n FROM present GROUP BY 1),
    expected AS (SELECT embedding_type, CAST(unnest(range(n)) AS INTEGER) AS chunk FROM counts)
    SELECT embedding_type, chunk FROM expected EXCEPT SELECT embedding_type, chunk FROM present""",
)
def chunk_gap_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("embedding_type"), F.col("l_quantity").cast("int").alias("chunk"))
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("embedding_type"), (F.col("p_size") * 2).alias("chunk"))
    return ids.chunk_gap_report(lines.unionByName(parts))


@query(
    "hydrate_results",
    """WITH r AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey AS pid FROM orders)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, pid, p_name AS name, p_brand AS brand, CAST(p_retailprice AS VARCHAR) AS price
    FROM r JOIN part ON p_partkey = pid WHERE rank <= 20""",
)
def hydrate_results(spark, sf_dir):
    from shelfmark.functions.ranking import top_k

    listed = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pid"), F.col("o_totalprice").alias("score")
    )
    goods = products(spark, sf_dir).select("pid", "name", "brand", F.col("price").cast("string").alias("price"))
    return facets.hydrate_results(top_k(listed, 20).select("query_id", "rank", "pid"), goods)


@query("fetch_by_pids", "SELECT p_partkey AS pid, p_name AS name FROM part WHERE p_partkey IN (SELECT l_suppkey FROM lineitem)")
def fetch_by_pids(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pid"))
    return facets.fetch_by_pids(products(spark, sf_dir).select("pid", "name"), asked)


SCORED = """SELECT user_id AS query_id, event_type AS component, CAST(props AS VARCHAR) AS pid, max(value) AS score FROM events GROUP BY 1, 2, 3"""


def scored_events(spark, sf_dir):
    """Component scores: the best value per session, event type and item."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("component"), F.col("props").alias("pid"))
        .agg(F.max("value").alias("score"))
    )


@query(
    "fuse_full_outer",
    f"""WITH s AS ({SCORED}), a AS (SELECT * FROM s WHERE component = 'click'), b AS (SELECT * FROM s WHERE component = 'purchase')
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.pid, b.pid) AS pid,
      round(0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0), 6) AS score
    FROM a FULL JOIN b ON a.query_id = b.query_id AND a.pid = b.pid""",
)
def fuse_full_outer(spark, sf_dir):
    scored = scored_events(spark, sf_dir)
    parts = [(scored.filter(F.col("component") == c), w) for c, w in (("click", 0.6), ("purchase", 0.4))]
    return hybrid.fuse_full_outer(parts).withColumn("score", F.round("score", 6))


@query(
    "hit_test",
    """WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS pid, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_partkey) AS rank FROM (
          SELECT l_orderkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3),
      t AS (SELECT l_orderkey AS query_id, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS target FROM lineitem GROUP BY 1)
    SELECT t.query_id, target, CAST(r.rank AS INTEGER) AS rank, r.rank IS NOT NULL AS hit FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.pid = t.target""",
)
def hit_test(spark, sf_dir):
    from shelfmark.functions.ranking import top_k

    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "query_id", "l_partkey": "pid"})
    results = top_k(lines.groupBy("query_id", "pid").agg(F.max("l_extendedprice").alias("score")), 3)
    targets = lines.groupBy("query_id").agg(F.min_by("pid", F.struct("l_linenumber", "pid")).alias("target"))
    return ids.hit_test(targets, results, 3)
