"""Image files named by product id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.embeddings import _open, qualified

# The first bytes of the image formats that are taken as readable.
MAGIC = {"jpeg": "FFD8FF", "png": "89504E47", "graymap": "5035"}


def scan_images(spark: SparkSession, folder: str, extension: str = "jpeg", content: bool = True) -> DataFrame:
    """(pid, content) of ``<pid>.<extension>`` files; files that do not start like an
    image are left out. With ``content=False`` files are only listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)
    pid = F.regexp_extract("path", rf"([^/]+)\.{extension}$", 1).alias("pid")
    if not content:
        return files.select(pid)
    start = F.hex(F.substring("content", 1, 4))
    readable = F.lit(False)
    for magic in MAGIC.values():
        readable = readable | start.startswith(magic)
    return files.filter(readable).select(pid, "content")


def write_images(df: DataFrame, folder: str, extension: str = "jpeg") -> DataFrame:
    """Save ``df(pid, content)`` as one file per row; returns the written names."""
    return write_files(df.select(F.concat(F.col("pid").cast("string"), F.lit(f".{extension}")).alias("name"), "content"), folder)


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Save ``df(name, content)`` as one file per row; returns the names."""
    folder = qualified(df.sparkSession, folder)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield batch.select([0])

    return df.select("name", "content").mapInArrow(save, "name string")
