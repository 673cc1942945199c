"""Vector, clustered-index and quantisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import vectors as V
from shelfmark.operators import encode, ivf, quantize, vectorstore, vectors as ops
from shelfmark.operators import nearest as nearest_ops
from shelfmark.operators.nearest import BlockSizes, nearest
from shelfmark.registry.base import (
    NAME_QUERIES,
    VECTORS,
    name_queries,
    query,
    ranked_sql,
    table,
    vectors,
)
from shelfmark.registry.ids import TYPED, typed_embeddings
from shelfmark.session import pinned, scratch_path, staged

NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def exploded(df, column="embedding"):
    """One row per vector entry, rounded, so that whole vectors are compared."""
    return df.select("pid", F.posexplode(column).alias("at", "x")).select("pid", (F.col("at") + 1).cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


def exploded_sql(source: str, v: str = "v") -> str:
    return f"SELECT pid, dim, round(x, 6) AS x FROM (SELECT pid, unnest({v}) AS x, generate_subscripts({v}, 1) AS dim FROM {source})"


DOUBLED = "doubled AS (SELECT pid, list_transform(v, lambda x: x * (label + 1)) AS v FROM vectors)"


def doubled(spark, sf_dir):
    """Vectors of other lengths than 1: scaled by their label + 1."""
    scale = F.col("label") + 1
    return vectors(spark, sf_dir).select("pid", F.transform(V.as_double(F.col("embedding")), lambda x: x * scale).alias("embedding"))


@query(
    "l2_normalize",
    f"WITH {VECTORS}, {DOUBLED}, n AS (SELECT pid, v, {NORM.format(v='v')} AS len FROM doubled), "
    f"u AS (SELECT pid, list_transform(v, lambda x: x / len) AS v FROM n WHERE len > 0) {exploded_sql('u')}",
)
def l2_normalize(spark, sf_dir):
    return exploded(ops.l2_normalize(doubled(spark, sf_dir)))


@query(
    "concat_embeddings",
    f"""WITH {TYPED}, c AS (SELECT i.pid, list_concat(i.v, t.v) AS v FROM typed i JOIN typed t USING (pid)
    WHERE i.embedding_type = 'image' AND t.embedding_type = 'text') {exploded_sql('c')}""",
)
def concat_embeddings(spark, sf_dir):
    typed = typed_embeddings(spark, sf_dir)
    return exploded(ops.concat_embeddings(typed.filter("embedding_type = 'image'"), typed.filter("embedding_type = 'text'")))


@query(
    "fuse_query_embedding",
    f"""WITH {TYPED}, q AS (
      SELECT i.pid, CASE WHEN i.pid % 3 <> 0 THEN i.v END AS image_vec, i.v AS image_text_vec, t.v AS sentence_vec
      FROM (SELECT * FROM typed WHERE embedding_type = 'image') i
      LEFT JOIN (SELECT * FROM typed WHERE embedding_type = 'text') t USING (pid)),
    c AS (SELECT pid, image_vec, sentence_vec, list_concat(coalesce(image_vec, image_text_vec), sentence_vec) AS j FROM q),
    f AS (SELECT pid, CASE WHEN sentence_vec IS NULL THEN image_vec
      ELSE list_transform(j, lambda x: x / {NORM.format(v='j')}) END AS v FROM c) {exploded_sql('f')}""",
)
def fuse_query_embedding(spark, sf_dir):
    typed = typed_embeddings(spark, sf_dir)
    image = typed.filter("embedding_type = 'image'").select("pid", F.col("embedding").alias("image_text_vec"))
    text = typed.filter("embedding_type = 'text'").select("pid", F.col("embedding").alias("sentence_vec"))
    queries = image.join(text, "pid", "left").withColumn("image_vec", F.when(F.col("pid") % 3 != 0, F.col("image_text_vec")))
    return exploded(ops.fuse_query_embedding(queries))


@query(
    "embedding_dim_check",
    f"""WITH {TYPED} SELECT embedding_type, CAST(min(len(v)) AS INTEGER) AS min_dim, CAST(max(len(v)) AS INTEGER) AS max_dim,
    count(*) AS n, min(len(v)) = max(len(v)) AS consistent FROM typed GROUP BY 1""",
)
def embedding_dim_check(spark, sf_dir):
    return ops.embedding_dim_check(typed_embeddings(spark, sf_dir))


HASH_DIM = 64
ENCODED = f"""enc_counts AS (SELECT pid, b, CAST(count(*) AS DOUBLE) AS n FROM (
      SELECT doc_id AS pid, (('0x' || substr(md5(w), 1, 7))::BIGINT) % {HASH_DIM} AS b FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE trim(text) <> '')) GROUP BY 1, 2),
    enc_len AS (SELECT pid, sqrt(sum(n * n)) AS len FROM enc_counts GROUP BY 1)"""


@query(
    "encode_text",
    f"""WITH {ENCODED} SELECT l.pid, d + 1 AS dim, round(coalesce(n, 0) / len, 6) AS x
    FROM (SELECT pid, len, unnest(range({HASH_DIM})) AS d FROM enc_len) l LEFT JOIN enc_counts c ON c.pid = l.pid AND c.b = d""",
)
def encode_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), "text")
    return exploded(encode.encode_text(docs, "text", dim=HASH_DIM))


def graymaps(spark, sf_dir):
    """Each vector as an 8 x 8 graymap picture; every tenth label is not a picture."""
    pixel = F.transform(V.as_double(F.col("embedding")), lambda x: F.lpad(F.hex(F.greatest(F.least(F.round(x * 200 + 128), F.lit(255.0)), F.lit(0.0)).cast("bigint")), 2, "0"))
    head = F.when(F.col("label") == 9, "GIF 8 8\n255\n").otherwise("P5 8 8\n255\n")
    return vectors(spark, sf_dir).select("pid", F.concat(F.encode(head, "UTF-8"), F.unhex(F.array_join(pixel, ""))).alias("content"))


PIXELS = """pix AS (SELECT vec_id AS pid, list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(least(round(x * 200 + 128), 255.0), 0.0)) AS p
    FROM embeddings WHERE label <> 9),
    enc AS (SELECT pid, list_transform(p, lambda x: x / sqrt(list_sum(list_transform(p, lambda y: y * y)))) AS v FROM pix)"""


@query("encode_image", f"WITH {PIXELS} {exploded_sql('enc')}")
def encode_image(spark, sf_dir):
    return exploded(encode.encode_image(graymaps(spark, sf_dir)))


# --- exact search ---------------------------------------------------------------------

COSINES = "cosines AS (SELECT query_id, pid, list_cosine_similarity(q.embedding, v.v) AS score FROM name_queries q, vectors v)"
BEST = "round(CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 0 ELSE score / max(score) OVER (PARTITION BY query_id) END, 6)"
KNN = f"WITH {NAME_QUERIES}, {VECTORS}, {COSINES} SELECT query_id, pid, CAST(rank AS INTEGER) AS rank, {BEST} AS score FROM ({ranked_sql('cosines', 10)})"


@query("knn_exact", KNN)
def knn_exact(spark, sf_dir):
    found = ops.knn_exact(name_queries(spark, sf_dir), vectors(spark, sf_dir), 10)
    return found.withColumn("score", F.round("score", 6))


@query("knn_exact_blocked", KNN)
def knn_exact_blocked(spark, sf_dir):
    """The plan for more queries than one task can hold, on the same input."""
    blocks = BlockSizes(probe_rows=16, vector_rows=1000)
    found = ops.knn_exact(name_queries(spark, sf_dir), vectors(spark, sf_dir), 10, blocks=blocks)
    return found.withColumn("score", F.round("score", 6))


MIXED = f"""{NAME_QUERIES}, {VECTORS},
    short AS (SELECT pid, CASE WHEN label % 3 = 0 THEN v[1:32] WHEN label = 7 THEN v[1:5] ELSE v END AS v FROM vectors),
    asked AS (SELECT query_id, embedding FROM name_queries UNION ALL SELECT concat(query_id, ' 32'), embedding[1:32] FROM name_queries
      UNION ALL SELECT concat(query_id, ' 7'), embedding[1:7] FROM name_queries)"""


def mixed_widths(spark, sf_dir):
    """Vectors of 64, 32 and 5 entries, queries of 64, 32 and 7."""
    v = vectors(spark, sf_dir)
    cut = F.when(F.col("label") % 3 == 0, F.slice("embedding", 1, 32)).when(F.col("label") == 7, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))
    q = name_queries(spark, sf_dir).select("query_id", "embedding")
    asked = q
    for n in (32, 7):
        asked = asked.unionByName(q.select(F.concat("query_id", F.lit(f" {n}")).alias("query_id"), F.slice("embedding", 1, n).alias("embedding")))
    return v.select("pid", cut.alias("embedding")), asked


@query(
    "knn_mixed_widths",
    f"""WITH {MIXED}, cosines AS (SELECT query_id, pid, list_cosine_similarity(q.embedding, s.v) AS score FROM asked q JOIN short s ON len(q.embedding) = len(s.v)),
    found AS ({ranked_sql('cosines', 10)})
    SELECT plan, query_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found, (VALUES ('scan'), ('grid')) AS p(plan)""",
)
def knn_mixed_widths(spark, sf_dir):
    """Vectors and queries of several lengths: both plans give the same rows."""
    v, asked = mixed_widths(spark, sf_dir)
    scan = nearest(v, asked, 10).withColumn("plan", F.lit("scan"))
    grid = nearest(v, asked, 10, blocks=BlockSizes(probe_rows=16, vector_rows=1000)).withColumn("plan", F.lit("grid"))
    return scan.unionByName(grid).withColumn("score", F.round("score", 6))


@query(
    "unmatched_widths",
    f"""WITH {MIXED}, v AS (SELECT len(v) AS width, count(*) AS n FROM short GROUP BY 1), q AS (SELECT len(embedding) AS width, count(*) AS n FROM asked GROUP BY 1)
    SELECT 'vectors' AS side, CAST(width AS INTEGER) AS width, n FROM v WHERE width NOT IN (SELECT width FROM q)
    UNION ALL SELECT 'probes', CAST(width AS INTEGER), n FROM q WHERE width NOT IN (SELECT width FROM v)""",
)
def unmatched_widths(spark, sf_dir):
    return nearest_ops.unmatched_widths(*mixed_widths(spark, sf_dir))


SCORED = "scored AS (SELECT o_custkey AS query_id, o_orderkey AS pid, o_totalprice AS score FROM orders)"


def scored_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pid"), F.col("o_totalprice").alias("score")
    )


@query("max_normalize", f"WITH {SCORED} SELECT query_id, pid, {BEST} AS score FROM scored")
def max_normalize(spark, sf_dir):
    from shelfmark.functions.ranking import max_normalize as normalize

    return normalize(scored_orders(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("topk_sort", f"WITH {SCORED} SELECT query_id, pid, score, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql('scored', 5)})")
def topk_sort(spark, sf_dir):
    from shelfmark.functions.ranking import top_k

    return top_k(scored_orders(spark, sf_dir), 5)


# --- clustered search -------------------------------------------------------------------


def seeds_sql(per_label: int) -> str:
    return f"""SELECT CAST(label * {per_label} + n - 1 AS INTEGER) AS cell, v AS centroid,
      CAST(count(*) OVER () AS INTEGER) AS nlist
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pid) AS n FROM vectors) WHERE n <= {per_label}"""


CENTROIDS = f"centroids AS ({seeds_sql(2)})"
POSTINGS = """postings AS (SELECT pid, v, nlist, cell FROM (
      SELECT pid, v, nlist, cell, row_number() OVER (PARTITION BY nlist, pid ORDER BY round(list_inner_product(v, centroid), 6) DESC, cell) AS n
      FROM vectors, centroids) WHERE n = 1)"""


def probes_sql(queries: str, nprobe: int) -> str:
    return f"""probes AS (SELECT * FROM (
      SELECT query_id, embedding, nlist, cell, row_number() OVER (PARTITION BY query_id, nlist ORDER BY round(list_inner_product(embedding, centroid), 6) DESC, cell) AS probe
      FROM {queries}, centroids) WHERE probe <= {nprobe})"""


IN_CELLS = """in_cells AS (SELECT query_id, pid, list_inner_product(embedding, v) AS score FROM probes JOIN postings USING (nlist, cell))"""
IVF = f"WITH {NAME_QUERIES}, {VECTORS}, {CENTROIDS}, {POSTINGS}, {probes_sql('name_queries', 4)}, {IN_CELLS}"


def seeds(spark, sf_dir, per_label=2):
    return ivf.ivf_seed(vectors(spark, sf_dir), "label", per_label)


def seeded_index(spark, sf_dir):
    v, c = vectors(spark, sf_dir), seeds(spark, sf_dir)
    return v, c, ivf.ivf_assign(v, c)


@query(
    "ivf_train",
    f"""WITH {VECTORS} SELECT CAST(16 AS INTEGER) AS nlist, CAST(16 AS BIGINT) AS cells, CAST(min(len(v)) AS INTEGER) AS dim,
    CAST(16 AS BIGINT) AS unit_centroids, count(*) AS assigned FROM vectors""",
)
def ivf_train(spark, sf_dir):
    """What must hold of any training: 16 cells of full width and length 1 that share out all vectors."""
    v = vectors(spark, sf_dir)
    trained = pinned(ivf.ivf_train(v, 16, iterations=5))
    assigned = ivf.ivf_assign(v, trained).groupBy("nlist", "cell").agg(F.count(F.lit(1)).alias("n"))
    unit = F.abs(V.norm(F.col("centroid")) - 1) < 1e-6
    return trained.join(assigned, ["nlist", "cell"], "left").groupBy("nlist").agg(
        F.count_distinct("cell").alias("cells"), F.min(F.size("centroid")).alias("dim"), F.count_if(unit).alias("unit_centroids"), F.sum(F.coalesce("n", F.lit(0))).alias("assigned")
    )


@query(
    "ivf_train_two_level",
    f"""WITH {VECTORS} SELECT CAST(count(*) // 20 AS INTEGER) AS nlist, count(*) // 20 AS cells, CAST(min(len(v)) AS INTEGER) AS dim,
    count(*) // 20 AS unit_centroids, count(*) AS assigned, true AS all_cells_are_exact FROM vectors""",
)
def ivf_train_two_level(spark, sf_dir):
    """A cell for each 20 vectors: what must hold of any training, and that probing all cells finds what a
    search of all vectors finds."""
    v, queries = vectors(spark, sf_dir), pinned(name_queries(spark, sf_dir))
    trained = pinned(ivf.ivf_train_two_level(v, v.count() // 20, iterations=2))
    posted = staged(ivf.ivf_assign(v, trained), "two-level")
    assigned = posted.groupBy("nlist", "cell").agg(F.count(F.lit(1)).alias("n"))
    unit = F.abs(V.norm(F.col("centroid")) - 1) < 1e-6
    n = trained.count()
    found = ivf.ivf_search(queries, trained, posted, 10, n).select("query_id", "pid", "rank")
    exact = nearest(v, queries, 10, "ip").select("query_id", "pid", "rank")
    same = exact.exceptAll(found).isEmpty() and found.exceptAll(exact).isEmpty()
    return trained.join(assigned, ["nlist", "cell"], "left").groupBy("nlist").agg(
        F.count_distinct("cell").alias("cells"), F.min(F.size("centroid")).alias("dim"), F.count_if(unit).alias("unit_centroids"), F.sum(F.coalesce("n", F.lit(0))).alias("assigned")
    ).withColumn("all_cells_are_exact", F.lit(same))


@query("ivf_seed", f"WITH {VECTORS}, {CENTROIDS}, s AS (SELECT cell AS pid, centroid AS v FROM centroids) {exploded_sql('s')}")
def ivf_seed(spark, sf_dir):
    return exploded(seeds(spark, sf_dir).select(F.col("cell").alias("pid"), F.col("centroid").alias("embedding")))


@query("ivf_assign", f"WITH {VECTORS}, {CENTROIDS}, {POSTINGS} SELECT nlist, cell, pid FROM postings")
def ivf_assign(spark, sf_dir):
    return seeded_index(spark, sf_dir)[2].select("nlist", "cell", "pid")


@query(
    "ivf_refine",
    f"""WITH {VECTORS}, {CENTROIDS}, {POSTINGS},
    m AS (SELECT cell, d, avg(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM postings) GROUP BY 1, 2),
    l AS (SELECT cell, sqrt(sum(x * x)) AS len FROM m GROUP BY 1)
    SELECT cell AS pid, d AS dim, round(x / len, 6) AS x FROM m JOIN l USING (cell)""",
)
def ivf_refine(spark, sf_dir):
    moved = ivf.ivf_refine(vectors(spark, sf_dir), seeds(spark, sf_dir))
    return exploded(moved.select(F.col("cell").alias("pid"), F.col("centroid").alias("embedding")))


@query("ivf_search", f"{IVF} SELECT query_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql('in_cells', 10)})")
def ivf_search(spark, sf_dir):
    _, c, p = seeded_index(spark, sf_dir)
    return ivf.ivf_search(name_queries(spark, sf_dir), c, p, 10, 4).withColumn("score", F.round("score", 6))


COSINE_IN_CELLS = IN_CELLS.replace("AS score FROM", "AS score, list_cosine_similarity(embedding, v) AS cosine FROM")
STORED = f"""WITH {NAME_QUERIES}, {VECTORS}, {CENTROIDS}, {POSTINGS}, {probes_sql('name_queries', 4)}, {COSINE_IN_CELLS}
    SELECT query_id, pid, round(score, 6) AS score, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql('in_cells', 10)})"""


def found_in_store(found):
    return found.select("query_id", "pid", F.round("score", 6).alias("score"), F.round("cosine", 6).alias("cosine"), "rank")


def stored_vectors(spark, sf_dir):
    return vectorstore.store_of(vectors(spark, sf_dir), seeds(spark, sf_dir), buckets=8)


@query("ivf_store_search", STORED)
def ivf_store_search(spark, sf_dir):
    """Cells read by bucket, the cosine from the same pass."""
    return found_in_store(vectorstore.search(stored_vectors(spark, sf_dir), name_queries(spark, sf_dir), 10, 4))


@query("ivf_sq8_search", STORED)
def ivf_sq8_search(spark, sf_dir):
    """By the codes, then what their error leaves open by the vectors: the same rows."""
    return found_in_store(vectorstore.search_codes(stored_vectors(spark, sf_dir), name_queries(spark, sf_dir), 10, 4))


@query("ivf_store_append", STORED)
def ivf_store_append(spark, sf_dir):
    """A store of a part of the vectors, the others added by two overlapping appends."""
    v, path = vectors(spark, sf_dir), scratch_path(spark, "vectors-appended")
    vectorstore.write_store(v.filter("label < 3"), seeds(spark, sf_dir), path, buckets=8)
    vectorstore.append_store(v.filter("label < 6"), path)
    vectorstore.append_store(v, path)
    return found_in_store(vectorstore.search_codes(vectorstore.read_store(spark, path), name_queries(spark, sf_dir), 10, 4))


@query(
    "ivf_sq8_recall",
    f"""WITH {NAME_QUERIES} SELECT query_id, true AS enough FROM name_queries""",
)
def ivf_sq8_recall(spark, sf_dir):
    """All cells probed, twice k rows kept by their codes alone: 0.9 of the exact top 10 at least."""
    queries, v = name_queries(spark, sf_dir), vectors(spark, sf_dir)
    found = vectorstore.search_codes(stored_vectors(spark, sf_dir), queries, 10, 20, keep=2)
    recall = ivf.ivf_recall(nearest(v, queries, 10, "ip"), found, ["query_id"], 10)
    return recall.select("query_id", (F.col("recall") >= 0.9).alias("enough"))


LAYERS = f"centroids AS ({seeds_sql(1)} UNION ALL {seeds_sql(3)})"


@query(
    "ivf_search_layers",
    f"""WITH {NAME_QUERIES}, {VECTORS}, {LAYERS}, {POSTINGS}, {probes_sql('name_queries', 4)}, {IN_CELLS.replace('score FROM', 'score, nlist FROM')},
    found AS ({ranked_sql('in_cells', 10, by='nlist, query_id')})
    SELECT nlist, query_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found""",
)
def ivf_search_layers(spark, sf_dir):
    """An index with two clusterings, each searched by itself."""
    v, c = vectors(spark, sf_dir), pinned(seeds(spark, sf_dir, 1).unionByName(seeds(spark, sf_dir, 3)))
    postings, queries = pinned(ivf.ivf_assign(v, c)), name_queries(spark, sf_dir)
    out = [ivf.ivf_search(queries, c, postings, 10, 4, nlist=n).withColumn("nlist", F.lit(n)) for n in (10, 30)]
    return out[0].unionByName(out[1]).withColumn("score", F.round("score", 6))


@query(
    "rescore_cosine",
    f"""{IVF}, found AS ({ranked_sql('in_cells', 10)})
    SELECT query_id, pid, round(list_cosine_similarity(q.embedding, v.v), 6) AS score FROM found JOIN vectors v USING (pid) JOIN name_queries q USING (query_id)""",
)
def rescore_cosine(spark, sf_dir):
    v, c, p = seeded_index(spark, sf_dir)
    queries = name_queries(spark, sf_dir)
    found = ivf.ivf_search(queries, c, p, 10, 4)
    return ops.rescore_cosine(found, queries, v).withColumn("score", F.round("score", 6))


# Two embedding types with ranges of their own.
RANGES = """entries AS (SELECT pid, label % 2 AS t, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vectors),
    lohi AS (SELECT t, d, min(x) AS lo, max(x) AS hi FROM entries GROUP BY 1, 2),
    codes AS (SELECT pid, t, d, CAST(CASE WHEN hi = lo THEN 0 ELSE round(255 * (x - lo) / (hi - lo)) END AS INTEGER) AS code
      FROM entries JOIN lohi USING (t, d))"""


def typed_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("embedding_type", (F.col("label") % 2).cast("string"))


@query("quantize_sq8", f"WITH {VECTORS}, {RANGES} SELECT pid, d AS dim, CAST(code AS DOUBLE) AS x FROM codes")
def quantize_sq8(spark, sf_dir):
    v = typed_vectors(spark, sf_dir)
    return exploded(quantize.sq8_encode(v, quantize.sq8_ranges(v)).select("pid", F.col("code").cast("array<double>").alias("embedding")))


@query(
    "sq8_search",
    f"""WITH {NAME_QUERIES}, {VECTORS}, {RANGES}, decoded AS (
      SELECT pid, list(lo + code * (hi - lo) / 255 ORDER BY d) AS v FROM codes JOIN lohi USING (t, d) GROUP BY 1),
    ips AS (SELECT query_id, pid, list_inner_product(embedding, v) AS score FROM name_queries, decoded)
    SELECT query_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql('ips', 10)})""",
)
def sq8_search(spark, sf_dir):
    v = typed_vectors(spark, sf_dir)
    ranges = quantize.sq8_ranges(v)
    found = quantize.sq8_search(name_queries(spark, sf_dir), quantize.sq8_encode(v, ranges), ranges, 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    "verify_index",
    f"""WITH {VECTORS}, {CENTROIDS}, {POSTINGS}, b AS (
      SELECT a.pid, max(list_cosine_similarity(a.v, b.v)) AS best FROM postings a LEFT JOIN postings b USING (nlist, cell) GROUP BY 1)
    SELECT count(*) AS checked, count(*) FILTER (WHERE best < 0.99) AS mismatches, coalesce(NOT bool_or(best < 0.99), true) AS ok FROM b""",
)
def verify_index(spark, sf_dir):
    return ivf.verify_index(*seeded_index(spark, sf_dir))


SWEEP_CENTROIDS = f"centroids AS ({seeds_sql(1)} UNION ALL {seeds_sql(3)})"
SWEEP = f"""WITH {NAME_QUERIES}, {VECTORS}, {SWEEP_CENTROIDS}, {POSTINGS}, {probes_sql('name_queries', 8)},
    runs AS (SELECT *, unnest([1, 2, 4, 8]) AS nprobe FROM probes),
    in_cells AS (SELECT r.nlist, r.nprobe, query_id, pid, list_inner_product(embedding, v) AS score FROM runs r JOIN postings p
      ON p.nlist = r.nlist AND p.cell = r.cell WHERE probe <= nprobe),
    found AS ({ranked_sql('in_cells', 10, by='nlist, nprobe, query_id')}),
    cosines AS (SELECT query_id, pid, list_cosine_similarity(q.embedding, v.v) AS score FROM name_queries q, vectors v),
    truth AS ({ranked_sql('cosines', 10)})"""
RECALL = """recalls AS (SELECT nlist, nprobe, query_id, count(t.pid) / 10.0::DOUBLE AS recall
    FROM found f LEFT JOIN truth t USING (query_id, pid) GROUP BY 1, 2, 3)"""


def sweep(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = seeds(spark, sf_dir, 1).unionByName(seeds(spark, sf_dir, 3))
    return ivf.ivf_sweep(name_queries(spark, sf_dir), c, ivf.ivf_assign(v, c), 10, [1, 2, 4, 8])


@query("sweep_configs", f"{SWEEP} SELECT nlist, CAST(nprobe AS INTEGER) AS nprobe, query_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found")
def sweep_configs(spark, sf_dir):
    return sweep(spark, sf_dir).withColumn("score", F.round("score", 6))


def sweep_recall(spark, sf_dir):
    exact = nearest(vectors(spark, sf_dir), name_queries(spark, sf_dir), 10)
    return ivf.ivf_recall(exact, sweep(spark, sf_dir), ["nlist", "nprobe", "query_id"], 10)


@query("ivf_recall", f"{SWEEP}, {RECALL} SELECT nlist, CAST(nprobe AS INTEGER) AS nprobe, query_id, round(recall, 6) AS recall FROM recalls")
def ivf_recall(spark, sf_dir):
    return sweep_recall(spark, sf_dir).withColumn("recall", F.round("recall", 6))


@query(
    "best_config",
    f"""{SWEEP}, {RECALL}, m AS (SELECT nlist, nprobe, round(avg(recall), 6) AS recall FROM recalls GROUP BY 1, 2)
    SELECT nlist, CAST(nprobe AS INTEGER) AS nprobe, recall FROM (
      SELECT *, row_number() OVER (PARTITION BY nlist ORDER BY recall DESC, nprobe) AS n FROM m) WHERE n = 1""",
)
def best_config(spark, sf_dir):
    from shelfmark.operators import evaluate

    runs = sweep_recall(spark, sf_dir).groupBy("nlist", "nprobe").agg(F.round(F.avg("recall"), 6).alias("recall"))
    return evaluate.best_config(runs, ["nlist"])


@query(
    "append_postings",
    f"""WITH {VECTORS}, {CENTROIDS}, {POSTINGS} SELECT nlist, cell, pid FROM postings WHERE pid NOT IN (SELECT doc_id FROM labels)""",
)
def append_postings(spark, sf_dir):
    v, c = vectors(spark, sf_dir), seeds(spark, sf_dir)
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pid"))
    return ivf.append_vectors(stored, v, c).select("nlist", "cell", "pid")
