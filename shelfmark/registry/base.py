"""The query register, and inputs that several queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import STOPWORDS
from shelfmark.functions.vectors import as_double

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the DuckDB text that has to give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run input-shaping SQL that both engines share; ``names`` are the tables in it."""
    frames = {n: table(spark, sf_dir, n) for n in names}
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **frames)


# --- messy product rows, as text, out of `part` -------------------------------------

RAW = """
SELECT p_partkey AS row_no,
  CASE WHEN p_partkey % 97 = 1 THEN NULL WHEN p_partkey % 89 = 1 THEN ''
       ELSE concat('P', CAST(p_partkey AS STRING)) END AS Pid,
  concat(p_name, CASE p_partkey % 7
    WHEN 0 THEN ' of soft Cotton for men, machine-washable'
    WHEN 1 THEN ', Eco-Friendly and eco friendly, Made in USA'
    WHEN 2 THEN ' elegant office item, lightweight'
    WHEN 3 THEN ' with steel and glass, modern and Modern'
    WHEN 4 THEN ' unisex, everyday use, easy to clean'
    WHEN 5 THEN ' wireless, noise-cancelling, sleek'
    ELSE ' plain' END) AS Description,
  CASE WHEN p_partkey % 53 = 3 THEN '  ' WHEN p_partkey % 61 = 5 THEN concat(chr(9), chr(160)) WHEN p_partkey % 59 = 4 THEN NULL
       WHEN p_partkey % 7 = 3 THEN concat(chr(160), p_name, chr(9)) ELSE p_name END AS Name,
  CASE WHEN p_partkey % 11 = 5 THEN NULL WHEN p_partkey % 13 = 6 THEN 'N/A'
       ELSE concat(p_type, ' > ', p_name) END AS Category,
  CASE WHEN p_partkey % 41 = 2 THEN 'invalid' WHEN p_partkey % 43 = 2 THEN '' WHEN p_partkey % 47 = 2 THEN 'NaN'
       ELSE CAST(p_retailprice AS STRING) END AS Price,
  CASE p_partkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'CAD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'EUR' ELSE NULL END AS PriceCurrency,
  CASE WHEN p_partkey % 37 = 2 THEN 'bad' WHEN p_partkey % 31 = 2 THEN NULL
       ELSE CAST(p_size AS STRING) END AS FinalPrice,
  CASE WHEN p_partkey % 29 = 2 THEN 'oops' WHEN p_partkey % 23 = 2 THEN '1e1' ELSE '4.0' END AS Discount,
  CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'True' WHEN 3 THEN 'maybe' WHEN 4 THEN '' ELSE NULL END AS isOnSale,
  CASE p_partkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'f' WHEN 2 THEN 'N' ELSE 'unknown' END AS IsInStock,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN upper(p_brand) ELSE p_brand END AS Brand,
  CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN '  ' WHEN p_partkey % 19 = 2 THEN chr(9)
       WHEN p_partkey % 7 = 5 THEN concat(lower(p_brand), chr(10), chr(160))
       WHEN p_partkey % 5 = 0 THEN concat(' ', lower(p_brand)) ELSE concat(p_type, ' Works') END AS Manufacturer,
  CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END AS Color,
  CASE p_partkey % 3 WHEN 0 THEN 'men' WHEN 1 THEN 'women' ELSE NULL END AS Gender,
  CASE WHEN p_partkey % 8 = 3 THEN 'null' ELSE CAST(p_size AS STRING) END AS Size,
  CASE p_partkey % 10 WHEN 7 THEN ' used ' WHEN 8 THEN '' ELSE 'new' END AS Condition
FROM part
"""


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RAW, "part")


# --- products, their text and their vectors -----------------------------------------

PRODUCTS = """
SELECT p_partkey AS pid, p_name AS name, p_brand AS brand, concat(p_type, ' > ', p_name) AS category,
  CAST(p_size AS STRING) AS size, p_retailprice AS price,
  lower(concat_ws(' ', p_name, p_type, p_brand, CAST(p_size AS STRING))) AS document
FROM part
"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PRODUCTS, "part")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "embedding", "label")


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per product name: the name as text, the mean vector of its products."""
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), "p_name")
    mean = Summarizer.mean(array_to_vector(as_double(F.col("embedding"))))
    return (
        vectors(spark, sf_dir)
        .join(named, "pid")
        .groupBy(F.col("p_name").alias("query_id"))
        .agg(mean.alias("m"))
        .select("query_id", F.col("query_id").alias("text"), vector_to_array("m").alias("embedding"))
    )


NAME_QUERIES = """name_queries AS (
  SELECT query_id, query_id AS text, list(m ORDER BY d) AS embedding FROM (
    SELECT query_id, d, avg(x) AS m FROM (
      SELECT p_name AS query_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d
      FROM embeddings JOIN part ON p_partkey = vec_id)
    GROUP BY 1, 2)
  GROUP BY 1)"""

VECTORS = "vectors AS (SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def ranked_sql(source: str, k: int, score: str = "score", by: str = "query_id") -> str:
    """The k best rows of ``source`` per query, on the rounded score, then id."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 6) DESC, pid) AS rank
      FROM {source}) WHERE rank <= {k}"""


# --- text search in SQL --------------------------------------------------------------

STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)


def stem_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 3 THEN {w}
      WHEN {w} LIKE '%ies' AND {w} NOT LIKE '%eies' AND {w} NOT LIKE '%aies' THEN regexp_replace({w}, 'ies$', 'y')
      WHEN {w} LIKE '%es' AND {w} NOT LIKE '%aes' AND {w} NOT LIKE '%ees' AND {w} NOT LIKE '%oes' THEN regexp_replace({w}, 'es$', 'e')
      WHEN {w} LIKE '%s' AND {w} NOT LIKE '%us' AND {w} NOT LIKE '%ss' THEN regexp_replace({w}, 's$', '')
      ELSE {w} END"""


def tokens_sql(name: str, source: str, ident: str, text: str) -> str:
    """CTE ``name(ident, position, term)``."""
    found = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return f"""{name} AS (
      SELECT {ident}, position, {stem_sql('w')} AS term
      FROM (SELECT {ident}, unnest({found}) AS w, generate_subscripts({found}, 1) AS position FROM {source})
      WHERE w NOT IN ({STOP_LIST}))"""


def search_sql(docs: str, queries: str) -> str:
    """CTEs from two sources (pid, document) and (query_id, text) to ``matched``: every
    (query_id, pid, term, tf) of the pairs in which all query terms occur."""
    return f"""{tokens_sql('doc_tokens', docs, 'pid', 'document')},
    {tokens_sql('query_tokens', queries, 'query_id', 'text')},
    postings AS (SELECT term, pid, count(*) AS tf FROM doc_tokens GROUP BY 1, 2),
    stats AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
    terms AS (SELECT DISTINCT query_id, term FROM query_tokens),
    n_terms AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
    pairs AS (SELECT query_id, pid, any_value(n) AS n FROM terms JOIN postings USING (term) JOIN n_terms USING (query_id)
              GROUP BY 1, 2 HAVING count(*) = any_value(n)),
    matched AS (SELECT query_id, pid, n, term, tf FROM pairs JOIN terms USING (query_id) JOIN postings USING (term, pid))"""


DOCUMENTS = "(SELECT doc_id AS pid, text AS document FROM documents)"
BENCHMARK = "(SELECT item_id AS query_id, text FROM benchmark)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), F.col("text").alias("document"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
