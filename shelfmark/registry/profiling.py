"""Profile and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import enrich, profile
from shelfmark.registry.base import RAW, STOP_LIST, documents, query, raw_products, table
from shelfmark.session import staged

WITH_RAW = f"WITH raw AS ({RAW})"
PROFILED = ["Name", "Category", "Brand", "Manufacturer", "Color", "Gender", "Size"]


@query(
    "null_share",
    WITH_RAW + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 6) AS null_percent FROM raw" for c in PROFILED
    ),
)
def null_share(spark, sf_dir):
    return profile.null_share(raw_products(spark, sf_dir), PROFILED).withColumn("null_percent", F.round("null_percent", 6))


@query(
    "distinct_counts",
    WITH_RAW + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM raw" for c in PROFILED),
)
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(raw_products(spark, sf_dir), PROFILED)


@query("distinct_sketches", " UNION ALL ".join(f"SELECT '{c}' AS column_name, true AS within" for c in PROFILED))
def distinct_sketches(spark, sf_dir):
    """Sketches of each currency's rows, united: within three standard errors of the exact counts."""
    raw = raw_products(spark, sf_dir)
    sketches = staged(profile.distinct_sketches(raw, PROFILED, ["PriceCurrency"]), "sketches")
    both = profile.sketched_counts(sketches).join(profile.distinct_counts(raw, PROFILED), "column_name")
    return both.select("column_name", (F.abs(F.col("estimate") - F.col("n_distinct")) <= 3 * F.col("error") * F.col("n_distinct")).alias("within"))


@query("value_share", f"{WITH_RAW} SELECT Brand AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM raw), 6) AS share FROM raw GROUP BY 1")
def value_share(spark, sf_dir):
    return profile.value_share(raw_products(spark, sf_dir), "Brand").withColumn("share", F.round("share", 6))


@query("value_counts", f"{WITH_RAW} SELECT Category AS value, count(*) AS n FROM raw WHERE Category IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(raw_products(spark, sf_dir), "Category")


@query(
    "length_range",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length FROM documents"
        for c in ("text", "source")
    ),
)
def length_range(spark, sf_dir):
    return profile.length_range(table(spark, sf_dir, "documents"), ["text", "source"])


HIT = "contains(lower(Description), lower(Gender))"


@query(
    "brand_in_name",
    f"""{WITH_RAW} SELECT count(*) AS rows, count(*) FILTER (WHERE {HIT}) AS hits,
    round(100.0::DOUBLE * count(*) FILTER (WHERE {HIT}) / count(*), 6) AS hit_percent FROM raw""",
)
def brand_in_name(spark, sf_dir):
    return profile.brand_in_name(raw_products(spark, sf_dir), "Description", "Gender").withColumn("hit_percent", F.round("hit_percent", 6))


@query(
    "null_share_in_subset",
    f"""{WITH_RAW}, m AS (SELECT * FROM raw WHERE NOT coalesce({HIT}, false))
    SELECT count(*) AS misses, count(*) FILTER (WHERE Gender IS NULL) AS without_brand,
    round(100.0::DOUBLE * count(*) FILTER (WHERE Gender IS NULL) / count(*), 6) AS without_brand_percent FROM m""",
)
def null_share_in_subset(spark, sf_dir):
    out = profile.null_share_in_subset(raw_products(spark, sf_dir), "Description", "Gender")
    return out.withColumn("without_brand_percent", F.round("without_brand_percent", 6))


@query("branded_misses", f"{WITH_RAW} SELECT row_no, Description, Gender FROM raw WHERE Gender IS NOT NULL AND NOT coalesce({HIT}, false)")
def branded_misses(spark, sf_dir):
    return profile.branded_misses(raw_products(spark, sf_dir), "Description", "Gender").select("row_no", "Description", "Gender")


@query(
    "conditional_counts",
    f"""{WITH_RAW} SELECT count(*) FILTER (WHERE contains(lower(Description), 'cotton')) AS cotton,
    count(*) FILTER (WHERE Gender = 'men') AS men, count(*) FILTER (WHERE Brand IS NULL AND Color IS NULL) AS bare FROM raw""",
)
def conditional_counts(spark, sf_dir):
    return profile.conditional_counts(
        raw_products(spark, sf_dir),
        {
            "cotton": F.contains(F.lower("Description"), F.lit("cotton")),
            "men": F.col("Gender") == "men",
            "bare": F.col("Brand").isNull() & F.col("Color").isNull(),
        },
    )


@query("clean_text", r"SELECT doc_id, regexp_replace(lower(text), '[^a-z\s]', '', 'g') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return enrich.clean_text(table(spark, sf_dir, "documents"), "text", "cleaned").select("doc_id", "cleaned")


CORPUS = rf"""corpus AS (SELECT doc_id AS pid, list_filter(
    regexp_extract_all(regexp_replace(lower(text), '[^a-z\s]', '', 'g'), '[a-z]{{2,}}'), lambda w: w NOT IN ({STOP_LIST})) AS w FROM documents)"""
GRAMS = """grams AS (
    SELECT pid, 1 AS n, unnest(w) AS gram FROM corpus
    UNION ALL SELECT pid, 2, array_to_string(w[i:i+1], ' ') FROM (SELECT pid, w, unnest(range(1, len(w))) AS i FROM corpus)
    UNION ALL SELECT pid, 3, array_to_string(w[i:i+2], ' ') FROM (SELECT pid, w, unnest(range(1, len(w) - 1)) AS i FROM corpus))"""


@query("top_ngrams", f"WITH {CORPUS}, {GRAMS} SELECT gram AS ngram, count(*) AS n FROM grams WHERE n <= 2 GROUP BY 1 ORDER BY n DESC, ngram LIMIT 50")
def top_ngrams(spark, sf_dir):
    return enrich.top_ngrams(table(spark, sf_dir, "documents"), "text", (1, 2), 50)


def _tags(family: str) -> str:
    found = f"regexp_extract_all(coalesce(Description, ''), '{enrich.tag_pattern(family)}')"
    return f"list_sort(list_distinct(list_transform({found}, lambda t: lower(t))))"


TAGS = ", ".join(f"{_tags(f)} AS tags_{f}" for f in enrich.TAG_FAMILIES)


@query(
    "extract_tags",
    f"{WITH_RAW}, tagged AS (SELECT row_no, {TAGS} FROM raw) SELECT row_no, "
    + ", ".join(f"array_to_string(tags_{f}, '|') AS tags_{f}" for f in enrich.TAG_FAMILIES) + " FROM tagged",
)
def extract_tags(spark, sf_dir):
    tagged = enrich.extract_tags(raw_products(spark, sf_dir), "Description")
    return tagged.select("row_no", *[F.array_join(f"tags_{f}", "|").alias(f"tags_{f}") for f in enrich.TAG_FAMILIES])


ALL_TAGS = f"""tagged AS (SELECT row_no, Name, Gender, Brand, Category, {TAGS} FROM raw),
    merged AS (SELECT *, array_to_string(list_sort(list_distinct(list_concat({', '.join(f'tags_{f}' for f in enrich.TAG_FAMILIES)}))), ' ') AS all_tags FROM tagged)"""


@query("merge_tags", f"{WITH_RAW}, {ALL_TAGS} SELECT row_no, all_tags FROM merged")
def merge_tags(spark, sf_dir):
    return enrich.merge_tags(enrich.extract_tags(raw_products(spark, sf_dir), "Description")).select("row_no", "all_tags")


@query(
    "combined_info",
    f"""{WITH_RAW}, {ALL_TAGS} SELECT row_no, 'name: ' || coalesce(Name, 'nan') || ', gender: ' || coalesce(Gender, 'nan') || ', brand: ' || coalesce(Brand, 'nan')
    || ', category: ' || coalesce(Category, 'nan') || ', tag: ' || coalesce(all_tags, 'nan') AS "CombinedInfo" FROM merged""",
)
def combined_info(spark, sf_dir):
    tagged = enrich.merge_tags(enrich.extract_tags(raw_products(spark, sf_dir), "Description"))
    fields = {"name": "Name", "gender": "Gender", "brand": "Brand", "category": "Category", "tag": "all_tags"}
    return enrich.combined_info(tagged, fields).select("row_no", "CombinedInfo")


@query("sample_fraction", "SELECT o_orderkey, o_totalprice FROM orders WHERE (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7))::BIGINT) % 10000 < 1000")
def sample_fraction(spark, sf_dir):
    return enrich.sample_fraction(table(spark, sf_dir, "orders"), 0.1, ident="o_orderkey").select("o_orderkey", "o_totalprice")


KEYWORD_DIM = 64


@query(
    "keyword_extract",
    f"""WITH {CORPUS}, {GRAMS},
    b AS (SELECT pid, (('0x' || substr(md5(w), 1, 7))::BIGINT) % {KEYWORD_DIM} AS b FROM (SELECT pid, unnest(w) AS w FROM corpus)),
    v AS (SELECT pid, b, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1, 2),
    len_of AS (SELECT pid, sqrt(sum(n * n)) AS length FROM v GROUP BY 1),
    cand AS (SELECT DISTINCT pid, gram FROM grams),
    gb AS (SELECT pid, gram, (('0x' || substr(md5(t), 1, 7))::BIGINT) % {KEYWORD_DIM} AS b, count(*) AS c
           FROM (SELECT pid, gram, unnest(string_split(gram, ' ')) AS t FROM cand) GROUP BY 1, 2, 3),
    s AS (SELECT gb.pid, gram, round(sum(c * n) / (sqrt(sum(c * c)) * any_value(length)), 6) AS score
          FROM gb JOIN v USING (pid, b) JOIN len_of ON len_of.pid = gb.pid GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, gram) AS rank FROM s)
    SELECT pid, CAST(rank AS INTEGER) AS rank, gram AS keyword, score FROM r WHERE rank <= 5""",
)
def keyword_extract(spark, sf_dir):
    return enrich.keyword_extract(documents(spark, sf_dir), 5, (1, 3), KEYWORD_DIM)
