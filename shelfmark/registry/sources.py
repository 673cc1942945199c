"""Source and sink queries: tables are written to scratch space and read back whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import clean, evaluate
from shelfmark.operators.encode import encode_image
from shelfmark.operators.ids import chunk_assign
from shelfmark.plans import index_build as plan
from shelfmark.registry.base import RAW, query, raw_products, table, tokens_sql, vectors
from shelfmark.registry.cleaning import HAS_KEY, MERGED, NULLED, number, strip
from shelfmark.registry.evaluation import LONG, PHRASED, phrased
from shelfmark.registry.ids import TYPED, typed_embeddings
from shelfmark.registry.vectors import PIXELS, VECTORS, exploded, exploded_sql, graymaps
from shelfmark.schema import RAW_COLUMNS
from shelfmark.session import scratch_path
from shelfmark.sources import embeddings, images, products

WITH_RAW = f"WITH raw AS ({RAW})"
NAME = "nullif(Name, '')"
#: A zip archive without members after some padding, in hexadecimal digits.
EMPTY_ARCHIVE = "00" * 64 + "504B0506" + "00" * 18


@query("scan_products_csv", f"{WITH_RAW} SELECT {NULLED} FROM raw")
def scan_products_csv(spark, sf_dir):
    path = scratch_path(spark, "raw-csv")
    raw_products(spark, sf_dir).select(*RAW_COLUMNS).write.options(**products.CSV_OPTIONS).csv(path)
    return products.scan_products_csv(spark, path)


@query("scan_benchmark_csv", f"WITH {PHRASED} SELECT CAST(item_id AS VARCHAR) AS item_id, natural_query, nullif(basic_query, '') AS basic_query, attribute_query FROM phrased")
def scan_benchmark_csv(spark, sf_dir):
    """The benchmark as a CSV with a byte order mark and line breaks inside quotes."""
    path = scratch_path(spark, "benchmark-csv")
    marked = phrased(spark, sf_dir).withColumnRenamed("item_id", "\ufeffitem_id")
    marked.write.options(**products.CSV_OPTIONS).csv(path)
    return products.scan_benchmark_csv(spark, path)


@query("scan_parquet_columns", "SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS l_shipdate FROM lineitem")
def scan_parquet_columns(spark, sf_dir):
    lines = products.scan_parquet_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_shipdate"])
    return lines.withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))


CHUNK_ROWS = 100
CHUNKED = f"SELECT 'fusion' AS embedding_type, CAST((row_number() OVER (ORDER BY vec_id) - 1) // {CHUNK_ROWS} AS INTEGER) AS chunk, CAST(vec_id AS VARCHAR) AS pid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def chunked(spark, sf_dir):
    """Chunks of a fixed number of rows."""
    numbered = chunk_assign(vectors(spark, sf_dir), "pid", CHUNK_ROWS)
    return numbered.select(F.lit("fusion").alias("embedding_type"), "chunk", F.col("pid").cast("string").alias("pid"), "embedding")


@query(
    "scan_embedding_chunks",
    f"SELECT embedding_type, chunk, pid, CAST(len(v) AS INTEGER) AS dim, round(list_sum(v), 6) AS total FROM ({CHUNKED})",
)
def scan_embedding_chunks(spark, sf_dir):
    """Every vector through `.npz` chunk files and back."""
    path = scratch_path(spark, "npz")
    embeddings.write_npz_chunks(chunked(spark, sf_dir), path).write.format("noop").mode("overwrite").save()
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    read = embeddings.scan_embedding_chunks(spark, path)
    return read.select("embedding_type", "chunk", "pid", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query(
    "chunk_rejects",
    f"""SELECT 'fusion' AS embedding_type, CAST(NULL AS INTEGER) AS chunk, 'read' AS reason, count(*) AS n FROM embeddings
    UNION ALL SELECT 'image', CAST(vec_id AS INTEGER), CASE vec_id % 2 WHEN 0 THEN 'no archive' ELSE 'missing array' END, 1 FROM embeddings WHERE label = 9""",
)
def chunk_rejects(spark, sf_dir):
    """Good chunks of all vectors, and for each vector of label 9 a file that is none."""
    path = scratch_path(spark, "npz-rejects")
    embeddings.write_npz_chunks(chunked(spark, sf_dir), path).write.format("noop").mode("overwrite").save()
    bad = vectors(spark, sf_dir).filter("label = 9").select("pid")
    images.write_files(bad.select(F.concat(F.lit("image_embeddings_chunk_"), "pid", F.lit(".npz")).alias("name"),
        F.when(F.col("pid") % 2 == 0, F.encode(F.lit("no archive"), "UTF-8")).otherwise(F.unhex(F.lit(EMPTY_ARCHIVE))).alias("content")), path).write.format("noop").mode("overwrite").save()
    read = embeddings.scan_embedding_chunks(spark, path).groupBy("embedding_type").agg(F.count(F.lit(1)).alias("n"))
    rejects = embeddings.chunk_rejects(spark, path).select("embedding_type", "chunk", "reason", F.lit(1).cast("bigint").alias("n"))
    return read.select("embedding_type", F.lit(None).cast("int").alias("chunk"), F.lit("read").alias("reason"), "n").unionByName(rejects)


@query("write_embedding_chunks", f"WITH {VECTORS} {exploded_sql('vectors')}")
def write_embedding_chunks(spark, sf_dir):
    path = scratch_path(spark, "chunks")
    embeddings.write_embedding_chunks(vectors(spark, sf_dir).withColumn("embedding_type", F.lit("image")), path, rows=100)
    return exploded(spark.read.parquet(path))


@query("scan_images", f"WITH {PIXELS} {exploded_sql('enc')}")
def scan_images(spark, sf_dir):
    """A picture file per vector, listed, checked and encoded; files of label 9 are no pictures."""
    path = scratch_path(spark, "images")
    images.write_images(graymaps(spark, sf_dir), path).write.format("noop").mode("overwrite").save()
    found = images.scan_images(spark, path).withColumn("pid", F.col("pid").cast("bigint"))
    return exploded(encode_image(found))


@query(
    "write_clean_products",
    f"""{WITH_RAW}, nulled AS (SELECT {NULLED} FROM raw)
    SELECT {strip('Pid')} AS "Pid", {strip('Name')} AS "Name", {number('Price')} AS "Price", {strip(MERGED)} AS "MergedBrand" FROM nulled WHERE PriceCurrency IN ('USD', 'CAD', 'GBP')""",
)
def write_clean_products(spark, sf_dir):
    path = scratch_path(spark, "clean")
    products.write_clean_products(clean.clean_products(raw_products(spark, sf_dir)), path)
    return products.scan_parquet_columns(spark, path, ["Pid", "Name", "Price", "MergedBrand"])


@query("product_table_write", f"{WITH_RAW} SELECT Pid, {strip(NAME)} AS \"Name\", {number('Price')} AS \"Price\" FROM raw WHERE {HAS_KEY}")
def product_table_write(spark, sf_dir):
    path = scratch_path(spark, "product-table")
    products.product_table_write(clean.cast_product_row(clean.drop_missing_key(raw_products(spark, sf_dir).drop("row_no"))), path)
    return products.scan_parquet_columns(spark, path, ["Pid", "Name", "Price"])


@query("summary_write", f"WITH {PHRASED}, {LONG} SELECT query_type, CAST(count(*) AS VARCHAR) AS queries FROM long GROUP BY 1")
def summary_write(spark, sf_dir):
    path = scratch_path(spark, "summary")
    long = evaluate.unpivot_queries(phrased(spark, sf_dir), ["item_id"])
    products.summary_write(long.groupBy("query_type").agg(F.count(F.lit(1)).alias("queries")), path)
    return spark.read.csv(path, header=True)


# --- the stored index -------------------------------------------------------------------

# Products as the index takes them: clean, one row per key, with a vector of each type.
COMPLETE = f"""nulled AS (SELECT row_no, {NULLED} FROM raw),
    kept AS (SELECT *, {MERGED} AS merged, row_number() OVER (PARTITION BY {strip('Pid')} ORDER BY row_no) AS n FROM nulled
      WHERE PriceCurrency IN ('USD', 'CAD', 'GBP') AND Pid IS NOT NULL),
    goods AS (SELECT {strip('Pid')} AS pid, {", ".join(f"{strip(c)} AS {c}" for c in ("Name", "Category", "merged", "Color", "Gender", "Size", "Condition"))} FROM kept WHERE n = 1),
    complete AS (SELECT pid, lower(concat_ws(' ', Name, Category, merged, Color, Gender, Size, Condition)) AS document FROM goods
      WHERE pid IN (SELECT concat('P', pid) FROM typed WHERE embedding_type = 'image') AND pid IN (SELECT concat('P', pid) FROM typed WHERE embedding_type = 'text')),
    {tokens_sql('t', 'complete', 'pid', 'document')},
    counted AS (SELECT pid, count(DISTINCT term) AS n_terms FROM t GROUP BY 1)"""
INDEXED = f"{WITH_RAW}, {TYPED}, {COMPLETE} SELECT pid, coalesce(n_terms, 0) AS n_terms, CAST(2 AS BIGINT) AS n_types FROM complete LEFT JOIN counted USING (pid)"


def index_inputs(spark, sf_dir):
    """Raw rows and the vectors of two types, with ids of one kind."""
    typed = typed_embeddings(spark, sf_dir)
    return raw_products(spark, sf_dir), typed.withColumn("pid", F.concat(F.lit("P"), F.col("pid").cast("string")))


def index_content(catalog):
    """What the tables of an index hold of each product."""
    terms = catalog.text.postings.groupBy("pid").agg(F.count(F.lit(1)).alias("n_terms"))
    types = reduce(DataFrame.unionAll, [v.select("pid") for v in catalog.vectors.values()]).groupBy("pid").agg(F.count(F.lit(1)).alias("n_types"))
    held = catalog.products.select(F.col("Pid").alias("pid")).join(terms, "pid", "left").join(types, "pid", "full")
    return held.select("pid", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_types", F.lit(0)).alias("n_types"))


@query("index_build", INDEXED)
def index_build(spark, sf_dir):
    path = scratch_path(spark, "index")
    raw, typed = index_inputs(spark, sf_dir)
    plan.write_index(raw, typed, path, max(1, raw.count() // 250), buckets=4)
    return index_content(plan.read_index(spark, path))


@query("index_append", INDEXED)
def index_append(spark, sf_dir):
    """Half of the products first, then all of them: only what is new is added."""
    raw, typed = index_inputs(spark, sf_dir)
    path = scratch_path(spark, "index")
    plan.write_index(raw.filter(F.crc32(F.coalesce("Pid", F.lit(""))) % 2 == 0), typed, path, max(1, raw.count() // 250), buckets=4)
    plan.append_index(raw, typed, path)
    return index_content(plan.read_index(spark, path))
