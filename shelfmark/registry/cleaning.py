"""Cleaning and validation queries, over messy rows derived from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.parsing import BLANK_ENDS
from shelfmark.operators import clean
from shelfmark.registry.base import RAW, query, raw_products, table
from shelfmark.schema import CLEAN_COLUMNS, FALSE_WORDS, MISSING_TOKENS, RAW_COLUMNS, TRUE_WORDS

WITH_RAW = f"WITH raw AS ({RAW})"
TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
NULLED = ", ".join(f"CASE WHEN {c} NOT IN ({TOKENS}) THEN {c} END AS {c}" for c in RAW_COLUMNS)
NUMBER = r"'\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*'"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, {NUMBER}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def boolean(c: str) -> str:
    return (
        f"CASE WHEN lower({c}) IN ({', '.join(map(repr, TRUE_WORDS))}) THEN true "
        f"WHEN lower({c}) IN ({', '.join(map(repr, FALSE_WORDS))}) THEN false END"
    )


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{BLANK_ENDS}', '', 'g')"


BRAND, MAKER = (f"lower({strip(coalesced)})" for coalesced in ("coalesce(Brand, '')", "coalesce(Manufacturer, '')"))
MERGED = f"CASE WHEN {BRAND} = {MAKER} THEN Brand ELSE coalesce(Brand, Manufacturer) END"
HAS_KEY = "Pid IS NOT NULL AND Pid <> ''"


@query("project_columns", f"{WITH_RAW} SELECT {', '.join(c for c in CLEAN_COLUMNS if c != 'MergedBrand')}, {MERGED} AS MergedBrand FROM raw")
def project_columns(spark, sf_dir):
    return clean.project_columns(clean.merge_brand(raw_products(spark, sf_dir)))


@query("required_columns", f"{WITH_RAW} SELECT Pid, Name, Description, Category, Price, PriceCurrency FROM raw")
def required_columns(spark, sf_dir):
    from shelfmark.schema import REQUIRED_COLUMNS

    return clean.required_columns(raw_products(spark, sf_dir)).select(*REQUIRED_COLUMNS)


@query("null_tokens", f"{WITH_RAW} SELECT row_no, {NULLED} FROM raw")
def null_tokens(spark, sf_dir):
    return clean.null_tokens(raw_products(spark, sf_dir))


@query("filter_currency", f"{WITH_RAW} SELECT row_no, PriceCurrency FROM raw WHERE PriceCurrency IN ('USD', 'CAD', 'GBP')")
def filter_currency(spark, sf_dir):
    return clean.filter_currency(raw_products(spark, sf_dir)).select("row_no", "PriceCurrency")


@query("normalize_brand_text", f'{WITH_RAW} SELECT row_no, {BRAND} AS "Brand_clean", {MAKER} AS "Manufacturer_clean" FROM raw')
def normalize_brand_text(spark, sf_dir):
    return clean.normalize_brand_text(raw_products(spark, sf_dir)).select("row_no", "Brand_clean", "Manufacturer_clean")


@query("merge_brand", f'{WITH_RAW} SELECT row_no, Brand, Manufacturer, {MERGED} AS "MergedBrand" FROM raw')
def merge_brand(spark, sf_dir):
    return clean.merge_brand(raw_products(spark, sf_dir)).select("row_no", "Brand", "Manufacturer", "MergedBrand")


@query(
    "validate_numeric",
    f'{WITH_RAW} SELECT row_no, {number("Price")} AS "Price", {number("FinalPrice")} AS "FinalPrice", {number("Discount")} AS "Discount" FROM raw',
)
def validate_numeric(spark, sf_dir):
    return clean.validate_numeric(raw_products(spark, sf_dir)).select("row_no", "Price", "FinalPrice", "Discount")


@query("validate_boolean", f'{WITH_RAW} SELECT row_no, {boolean("isOnSale")} AS "isOnSale", {boolean("IsInStock")} AS "IsInStock" FROM raw')
def validate_boolean(spark, sf_dir):
    return clean.validate_boolean(raw_products(spark, sf_dir)).select("row_no", "isOnSale", "IsInStock")


@query(
    "validate_text",
    f"""{WITH_RAW} SELECT row_no, {strip("nullif(Name, '')")} AS "Name", {strip("nullif(Condition, '')")} AS "Condition",
    {strip("nullif(Manufacturer, '')")} AS "Manufacturer" FROM raw""",
)
def validate_text(spark, sf_dir):
    fields = ["Name", "Condition", "Manufacturer"]
    return clean.validate_text(raw_products(spark, sf_dir), fields).select("row_no", *fields)


@query("drop_missing_key", f"{WITH_RAW} SELECT row_no, Pid FROM raw WHERE {HAS_KEY}")
def drop_missing_key(spark, sf_dir):
    return clean.drop_missing_key(raw_products(spark, sf_dir)).select("row_no", "Pid")


@query(
    "drop_report",
    f"""{WITH_RAW}, c AS (SELECT count(*) AS original_rows, count(*) FILTER (WHERE {HAS_KEY}) AS valid_rows FROM raw)
    SELECT original_rows, valid_rows, original_rows - valid_rows AS dropped_rows,
      round(100.0::DOUBLE * (original_rows - valid_rows) / original_rows, 2) AS dropped_percent FROM c""",
)
def drop_report(spark, sf_dir):
    return clean.drop_report(raw_products(spark, sf_dir))


def _bad(field: str, parsed: str) -> str:
    return f"SELECT '{field}' AS field, count(*) FILTER (WHERE {field} IS NOT NULL AND {field} <> '' AND ({parsed}) IS NULL) AS invalid FROM raw"


@query(
    "invalid_value_report",
    WITH_RAW + " "
    + " UNION ALL ".join(
        [_bad(c, number(c)) for c in ("Price", "FinalPrice", "Discount")]
        + [_bad(c, boolean(c)) for c in ("isOnSale", "IsInStock")]
    ),
)
def invalid_value_report(spark, sf_dir):
    return clean.invalid_value_report(raw_products(spark, sf_dir))


@query(
    "filter_valid_products",
    f"""{WITH_RAW} SELECT row_no, Pid, Name FROM raw WHERE coalesce({strip('Name')}, '') <> ''
    AND Pid IN (SELECT concat('P', CAST(vec_id AS VARCHAR)) FROM embeddings)""",
)
def filter_valid_products(spark, sf_dir):
    images = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("Pid"))
    return clean.filter_valid_products(raw_products(spark, sf_dir), images).select("row_no", "Pid", "Name")


@query("filter_nonblank_text", f"{WITH_RAW} SELECT row_no, Name FROM raw WHERE {strip('Name')} <> ''")
def filter_nonblank_text(spark, sf_dir):
    return clean.filter_nonblank_text(raw_products(spark, sf_dir), "Name").select("row_no", "Name")


@query(
    "cast_product_row",
    f"""{WITH_RAW} SELECT Pid, {strip("nullif(Name, '')")} AS "Name", {strip("nullif(Category, '')")} AS "Category",
    {number('Price')} AS "Price", {boolean('isOnSale')} AS "isOnSale", {strip("nullif(Condition, '')")} AS "Condition"
    FROM (SELECT * REPLACE ({strip("nullif(Pid, '')")} AS Pid) FROM raw)""",
)
def cast_product_row(spark, sf_dir):
    raw = raw_products(spark, sf_dir).drop("row_no")
    return clean.cast_product_row(raw).select("Pid", "Name", "Category", "Price", "isOnSale", "Condition")


@query(
    "build_document",
    f"""{WITH_RAW} SELECT row_no, lower(concat_ws(' ', Name, Category, {MERGED}, Color, Gender, Size, Condition)) AS document FROM raw""",
)
def build_document(spark, sf_dir):
    return clean.build_document(clean.merge_brand(raw_products(spark, sf_dir))).select("row_no", "document")


@query(
    "filter_text_contains",
    f"""{WITH_RAW} SELECT row_no, Name, 'has' AS side FROM raw WHERE coalesce(contains(lower(Name), 'ring'), false)
    UNION ALL SELECT row_no, Name, 'has not' AS side FROM raw WHERE NOT coalesce(contains(lower(Name), 'ring'), false)""",
)
def filter_text_contains(spark, sf_dir):
    raw = raw_products(spark, sf_dir).select("row_no", "Name")
    has = clean.filter_text_contains(raw, "Name", "RING").withColumn("side", F.lit("has"))
    lacks = clean.filter_text_contains(raw, "Name", "RING", negate=True).withColumn("side", F.lit("has not"))
    return has.unionByName(lacks)


@query("filter_exact", f"{WITH_RAW} SELECT row_no, Name, Category FROM raw WHERE Gender = 'women'")
def filter_exact(spark, sf_dir):
    return clean.filter_exact(raw_products(spark, sf_dir), "Gender", "women").select("row_no", "Name", "Category")


@query(
    "clean_products",
    f"""{WITH_RAW}, nulled AS (SELECT {NULLED} FROM raw),
    kept AS (SELECT *, {MERGED} AS merged FROM nulled WHERE PriceCurrency IN ('USD', 'CAD', 'GBP'))
    SELECT {', '.join(strip(f"nullif({c}, '')") + f" AS {c}" for c in ('Pid', 'Description', 'Name', 'Category', 'PriceCurrency', 'Color', 'Gender', 'Size', 'Condition'))},
      {', '.join(f'{number(c)} AS {c}' for c in ('Price', 'FinalPrice', 'Discount'))},
      {', '.join(f'{boolean(c)} AS {c}' for c in ('isOnSale', 'IsInStock'))},
      {strip("nullif(merged, '')")} AS "MergedBrand" FROM kept""",
)
def clean_products(spark, sf_dir):
    return clean.clean_products(raw_products(spark, sf_dir))


@query(
    "detect_modality",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND value > 10 THEN 'multimodal'
      WHEN value > 10 THEN 'image' WHEN event_type IN ('view', 'click') THEN 'text' END AS modality FROM events""",
)
def detect_modality(spark, sf_dir):
    from shelfmark.operators.hybrid import detect_modality as detect

    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("view", "click"), F.col("props")).otherwise(F.lit(" ")).alias("query_text"),
        F.when(F.col("value") > 10, F.lit("image")).alias("query_image"),
    )
    return detect(requests).select("event_id", "modality")
