"""The register of the corpus queries and what several operators share.

All operators read only the columns they name, so further columns of an input, also ones
that carry the name of an output, are without effect.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word is a run of characters other than space and the control characters tab to return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Row id inside an operator.
ROW = "_row"


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


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends there, and
    a lost executor finds the same rows in the same files."""
    path = scratch_path(df.sparkSession, name)
    if _noted is not None:
        _noted.append(path)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_noted: list[str] | None = None


@contextlib.contextmanager
def noted(paths: list[str]):
    """Add the folders of the tables that are stored meanwhile to ``paths``, so that they can be forgotten
    when what was made of them is written."""
    global _noted
    before, _noted = _noted, paths
    try:
        yield
    finally:
        _noted = before


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more, and empty the list."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a unique ``_row``, stored so that every later read sees the same ids."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
