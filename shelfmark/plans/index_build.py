"""Raw products and embeddings to a stored index, and additions to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import vectors as V
from shelfmark.functions.parsing import parse_text
from shelfmark.operators import clean, ids, ivf, textstore, vectorstore
from shelfmark.operators.hybrid import Catalog
from shelfmark.session import staged
from shelfmark.sources.tables import append_folder, parts, replace_folder


def build_products(raw: DataFrame) -> DataFrame:
    """Clean, key-checked product rows with their search text; of rows with one id the first
    of the input (by file and row) that passes the currency filter."""
    placed = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("Pid", parse_text(F.col("Pid").cast("string")))
    kept = clean.drop_missing_key(clean.filter_currency(clean.null_tokens(clean.required_columns(placed))))
    once = ids.dedup_first(kept, "_at", "Pid").drop("_at")
    return clean.build_document(clean.clean_products(once))


def _complete(raw: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The products that have a vector of every embedding type, written once for all that read them."""
    products = build_products(raw)
    whole = ids.intersect_ids(products.select(F.col("Pid").alias("pid")), embeddings)
    return staged(products.join(whole.select(F.col("pid").alias("Pid")), "Pid", "left_semi"), "index-products")


def _vectors_of(embeddings: DataFrame, kind: str, products: DataFrame) -> DataFrame:
    """One vector per product, of the lowest value where an id has several."""
    mine = embeddings.filter(F.col("embedding_type") == kind).join(products.select(F.col("Pid").alias("pid")), "pid", "left_semi")
    return mine.groupBy("pid").agg(F.min("embedding").alias("embedding"))


#: Cells up to which one k-means trains all of them at once; its work grows with vectors times cells.
ONE_LEVEL_CELLS = 256


def _trained(vectors: DataFrame, nlist: int, seed: int) -> DataFrame:
    """Centroids of ``nlist`` cells, or of as many as the vectors can train; many cells are trained in two levels."""
    usable = vectors.filter(V.l2_normalize(F.col("embedding")).isNotNull()).count()
    cells = max(1, min(nlist, usable // ivf.MIN_ROWS_PER_CELL))
    return (ivf.ivf_train if cells <= ONE_LEVEL_CELLS else ivf.ivf_train_two_level)(vectors, cells, seed)


def write_index(raw: DataFrame, embeddings: DataFrame, path: str, nlist: int, seed: int = 42, buckets: int = vectorstore.BUCKETS) -> None:
    """The index of raw product rows and ``embeddings(pid, embedding_type, embedding)`` at ``path``, in
    place of the one that is there.

    ``nlist`` is an upper bound: a table that cannot train so many cells gets fewer.
    Products without a key, of other currencies or without a vector of each type are left out,
    as in the tables of the index all ids have to be the same. Everything is written beside the old
    index, which is read until the last table of the new one is there.
    """
    spark = raw.sparkSession

    def write(folder: str) -> None:
        products = _complete(raw, embeddings)
        kinds = sorted(r["embedding_type"] for r in embeddings.select("embedding_type").distinct().collect())
        for kind in kinds:
            vectors = staged(_vectors_of(embeddings, kind, products), "index-vectors")
            vectorstore.write_store(vectors, _trained(vectors, nlist, seed), f"{folder}/vectors-{kind}", buckets)
        textstore.write_store(products.select(F.col("Pid").alias("pid"), "document"), f"{folder}/text", buckets)
        replace_folder(spark, f"{folder}/products", _product_writer(products))
        spark.createDataFrame([(k,) for k in kinds], "kind string").write.parquet(f"{folder}/kinds")

    replace_folder(spark, path, write)


def _product_writer(products: DataFrame):
    return lambda folder: products.repartitionByRange("Pid").sortWithinPartitions("Pid").write.parquet(folder)


def append_index(raw: DataFrame, embeddings: DataFrame, path: str) -> None:
    """Add the products whose ids the index does not hold yet. Centroids and the layout stay as they are.

    Vectors come first, then text, then products; each is a part of its own that appears as a
    whole. An addition that fails on the way can be run again: tables that have the ids already
    take nothing twice, and results without a product row are dropped when they are looked up.
    """
    spark = raw.sparkSession
    folder = parts(spark, path)[0]
    held = spark.read.parquet(*parts(spark, f"{folder}/products")).select("Pid")
    new = staged(_complete(raw, embeddings).join(held, "Pid", "left_anti"), "index-new")
    for kind in _kinds(spark, folder):
        vectorstore.append_store(_vectors_of(embeddings, kind, new), f"{folder}/vectors-{kind}")
    textstore.append_store(new.select(F.col("Pid").alias("pid"), "document"), f"{folder}/text")
    append_folder(spark, f"{folder}/products", _product_writer(new))


def _kinds(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r["kind"] for r in spark.read.parquet(f"{folder}/kinds").collect())


def read_index(spark: SparkSession, path: str) -> Catalog:
    folder = parts(spark, path)[0]
    stores = {kind: vectorstore.read_store(spark, f"{folder}/vectors-{kind}") for kind in _kinds(spark, folder)}
    return Catalog(
        products=spark.read.parquet(*parts(spark, f"{folder}/products")),
        text=textstore.read_store(spark, f"{folder}/text"),
        vectors={kind: store.cells.filter(F.col("nlist") == store.finest).select("pid", "embedding") for kind, store in stores.items()},
        stores=stores,
    )
