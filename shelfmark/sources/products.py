"""Product and benchmark scans, product sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.clean import null_tokens
from shelfmark.schema import RAW_COLUMNS
from shelfmark.sources.tables import swap_folder

_BOM = "\ufeff"

# Text is written as it is: quotes doubled, outer blanks kept.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as text, by header name. Files of one path have to have one header: another
    order of columns is an error, as it would be read into wrong columns. Quoted line breaks need
    ``multi_line``, which reads each file in one task: ship such data as many files."""
    options = {"header": True, "multiLine": multi_line, "escape": '"', "quote": '"', "emptyValue": ""}
    schema = spark.read.csv(path, **options).schema
    df = spark.read.schema(schema).csv(path, enforceSchema=False, **options)
    return df.toDF(*[c.strip(_BOM) for c in df.columns])


def scan_products_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    df = _csv(spark, path, multi_line)
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS]
    return null_tokens(df.select(*columns))


def scan_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark queries, missing-token texts as NULL; a byte order mark before the first column
    name is removed."""
    return null_tokens(_csv(spark, path, True))


def scan_parquet_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_clean_products(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write cleaned rows in place of the table at ``path``, which a failed write leaves as it was."""
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"unknown file format: {file_format}")
    options = CSV_OPTIONS if file_format == "csv" else {}
    swap_folder(df.sparkSession, path, lambda folder: df.write.options(**options).format(file_format).save(folder))


def product_table_write(df: DataFrame, path: str, key: str = "Pid") -> None:
    """The product table as files sorted by key, so that id lookups skip row groups. It is written
    beside the old one and then takes its place: a failed load leaves the old table."""
    rows = df.repartitionByRange(key).sortWithinPartitions(key)
    swap_folder(df.sparkSession, path, lambda folder: rows.write.parquet(folder))


def product_table_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], batch_rows: int = 3000) -> None:
    df.write.mode("append").option("batchsize", batch_rows).jdbc(url, table, properties=properties)


def summary_write(df: DataFrame, path: str) -> None:
    swap_folder(df.sparkSession, path, lambda folder: df.write.options(**CSV_OPTIONS).csv(folder))
