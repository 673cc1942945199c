"""Cleaning and validation of product rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import parsing as P
from shelfmark.schema import (
    BOOLEAN_COLUMNS,
    CLEAN_COLUMNS,
    CURRENCIES,
    DOCUMENT_COLUMNS,
    MISSING_TOKENS,
    NUMERIC_COLUMNS,
    REQUIRED_COLUMNS,
)


def project_columns(df: DataFrame, columns: Sequence[str] = CLEAN_COLUMNS) -> DataFrame:
    return df.select(*columns)


def required_columns(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are absent: {', '.join(absent)}")
    return df


def null_tokens(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Texts that mean "missing" become NULL in every string column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: P.missing_to_null(F.col(c), tokens) for c in texts})


def filter_currency(df: DataFrame, currencies: Sequence[str] = CURRENCIES) -> DataFrame:
    return df.filter(F.col("PriceCurrency").isin(list(currencies)))


def normalize_brand_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_clean": P.brand_key(F.col(c)) for c in ("Brand", "Manufacturer")})


def merge_brand(df: DataFrame) -> DataFrame:
    """Brand where brand and manufacturer read the same, else the first that is set."""
    same = P.brand_key(F.col("Brand")) == P.brand_key(F.col("Manufacturer"))
    merged = F.when(same, F.col("Brand")).otherwise(F.coalesce("Brand", "Manufacturer"))
    return df.withColumn("MergedBrand", merged)


def validate_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: P.parse_number(F.col(c)) for c in columns if c in df.columns})


def validate_boolean(df: DataFrame, columns: Sequence[str] = BOOLEAN_COLUMNS) -> DataFrame:
    def parsed(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, T.BooleanType):
            return F.col(c)
        return P.number_to_boolean(F.col(c)) if isinstance(kind, T.NumericType) else P.parse_boolean(F.col(c))

    return df.withColumns({c: parsed(c) for c in columns if c in df.columns})


def validate_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trimmed text; lists and maps are not text and become NULL."""

    def parsed(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.lit(None).cast("string")
        return P.parse_text(F.col(c).cast("string"))

    return df.withColumns({c: parsed(c) for c in columns})


def drop_missing_key(df: DataFrame, key: str = "Pid") -> DataFrame:
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def drop_report(df: DataFrame, key: str = "Pid") -> DataFrame:
    """Row counts before and after dropping rows without a key, in one pass."""
    valid = F.count_if(F.col(key).isNotNull() & (F.col(key) != ""))
    counts = df.agg(F.count(F.lit(1)).alias("original_rows"), valid.alias("valid_rows"))
    dropped = F.col("original_rows") - F.col("valid_rows")
    percent = F.round(F.try_divide(F.lit(100.0) * dropped, F.col("original_rows")), 2)
    return counts.withColumns({"dropped_rows": dropped, "dropped_percent": percent})


def invalid_value_report(df: DataFrame) -> DataFrame:
    """How many set values per field could not be read and became NULL."""
    parsed = {c: P.parse_number(F.col(c)) for c in NUMERIC_COLUMNS if c in df.columns}
    parsed |= {c: P.parse_boolean(F.col(c)) for c in BOOLEAN_COLUMNS if c in df.columns}

    def bad(c: str):
        given = F.col(c).isNotNull() & (F.col(c) != "")
        return F.count_if(given & parsed[c].isNull()).alias(c)

    wide = df.agg(*[bad(c) for c in parsed])
    return wide.unpivot([], list(parsed), "field", "invalid")


def filter_valid_products(products: DataFrame, images: DataFrame) -> DataFrame:
    """Products that have an image and a name."""
    named = products.filter(~P.is_blank(F.col("Name")))
    return named.join(images.select("Pid"), "Pid", "left_semi")


def filter_nonblank_text(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~P.is_blank(F.col(column)))


def cast_product_row(df: DataFrame) -> DataFrame:
    """Table types for raw text columns; what cannot be read is NULL."""
    texts = [c for c in df.columns if c not in NUMERIC_COLUMNS + BOOLEAN_COLUMNS]
    return validate_text(validate_boolean(validate_numeric(df)), texts)


def build_document(df: DataFrame, columns: Sequence[str] = DOCUMENT_COLUMNS) -> DataFrame:
    return df.withColumn("document", P.text_key(*[F.col(c) for c in columns]))


def filter_text_contains(df: DataFrame, column: str, needle: str, negate: bool = False) -> DataFrame:
    """Case-insensitive contains; a NULL text contains nothing."""
    hit = F.coalesce(F.contains(F.lower(F.col(column)), F.lit(needle.lower())), F.lit(False))
    return df.filter(~hit if negate else hit)


def filter_exact(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def clean_products(raw: DataFrame) -> DataFrame:
    """Raw rows to the clean column set: currencies kept, brands merged, values typed."""
    kept = filter_currency(null_tokens(required_columns(raw)))
    return cast_product_row(project_columns(merge_brand(kept)))
