"""Embedding chunks as Parquet and as ``.npz`` files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.nearest import matrix
from shelfmark.schema import CHUNK_ROWS

EMBEDDING_SCHEMA = "embedding_type string, chunk int, pid string, embedding array<float>"
_READ_ROWS = 4096

# Chunk files are named <type>_embeddings_chunk_<n>.npz or <type>_embeddings.npz
# and hold these arrays.
FILE_NAME = r"([^/]+?)_embeddings(?:_chunk_([0-9]+))?\.npz$"
VECTORS_KEY, IDS_KEY = "embeddings", "product_ids"


def embedding_type_of(path):
    return F.regexp_extract(path, FILE_NAME, 1)


def chunk_of(path):
    """The chunk number as a number, so that chunk 10 follows chunk 9."""
    return F.coalesce(F.nullif(F.regexp_extract(path, FILE_NAME, 2), F.lit("")).cast("int"), F.lit(0))


def list_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, embedding_type, chunk) of the chunk files, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_embeddings*.npz").load(folder)
    return files.select("path", embedding_type_of(F.col("path")).alias("embedding_type"), chunk_of(F.col("path")).alias("chunk"))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the file system that Spark takes it to be on: without a scheme that is
    the cluster's default, not the disk of the machine that runs a task."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    return fs.FileSystem.from_uri(path)


class ChunkFault(Exception):
    """Why the content of a chunk file cannot be used. Faults of the file system are not
    among them: they fail the task, which is then tried again."""


def _header(member) -> tuple[tuple[int, ...], bool, np.dtype]:
    try:
        version = npy.read_magic(member)
        shape, fortran, dtype = npy.read_array_header_1_0(member) if version == (1, 0) else npy.read_array_header_2_0(member)
    except ValueError as fault:
        raise ChunkFault("broken array header") from fault
    if dtype.hasobject:
        raise ChunkFault("array of objects")
    return shape, fortran, dtype


def _slices(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of one chunk a few thousand rows at a time. A chunk that lacks an array,
    has unequal lengths or is no archive raises ``ChunkFault`` before its first rows."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        try:
            archive = zipfile.ZipFile(file)
        except (zipfile.BadZipFile, pa.ArrowInvalid) as fault:  # the second: too short to be searched
            raise ChunkFault("no archive") from fault
        names = {n.removesuffix(".npy"): n for n in archive.namelist()}
        if VECTORS_KEY not in names or IDS_KEY not in names:
            raise ChunkFault("missing array")
        with archive, archive.open(names[VECTORS_KEY]) as vectors, archive.open(names[IDS_KEY]) as ids:
            (shape, fortran, kind), (id_shape, _, id_kind) = _header(vectors), _header(ids)
            if len(shape) != 2 or len(id_shape) != 1 or shape[0] != id_shape[0]:
                raise ChunkFault("unequal lengths")
            if fortran and 1 not in shape:
                # Columns lie one after the other: the whole array, one chunk, is needed for a row.
                whole = np.frombuffer(vectors.read(shape[0] * shape[1] * kind.itemsize), kind).reshape(shape, order="F")
            for at in range(0, shape[0], _READ_ROWS):
                n = min(_READ_ROWS, shape[0] - at)
                if fortran and 1 not in shape:
                    block = whole[at : at + n]
                else:
                    block = np.frombuffer(vectors.read(n * shape[1] * kind.itemsize), kind).reshape(n, shape[1])
                yield np.frombuffer(ids.read(n * id_kind.itemsize), id_kind), block


def chunk_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``embedding_type``, ``chunk`` and ``reason`` of each chunk that
    ``scan_embedding_chunks`` leaves out. Only archive directories and headers are read, and
    the rows of a slice."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                try:
                    next(_slices(row.path), None)
                except ChunkFault as fault:
                    yield pd.DataFrame({"path": [row.path], "embedding_type": [row.embedding_type], "chunk": [row.chunk], "reason": [str(fault)]})

    return list_chunks(spark, folder).repartition("path").mapInPandas(read, "path string, embedding_type string, chunk int, reason string")


def scan_embedding_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(embedding_type, chunk, pid, embedding) of all chunk files, a task per file. Chunks whose
    content cannot be used are left out and listed by ``chunk_rejects``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                try:
                    for ids, block in _slices(row.path):
                        yield pd.DataFrame(
                            {
                                "embedding_type": row.embedding_type,
                                "chunk": row.chunk,
                                "pid": ids.astype(str),
                                "embedding": list(block.astype("float32")),
                            }
                        )
                except ChunkFault:
                    continue

    listed = list_chunks(spark, folder)
    return listed.repartition("path").mapInPandas(read, EMBEDDING_SCHEMA)


def write_embedding_chunks(df: DataFrame, path: str, rows: int = CHUNK_ROWS) -> None:
    """Parquet files of at most ``rows`` vectors per embedding type."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("embedding_type").parquet(path)


def write_npz_chunks(df: DataFrame, folder: str) -> DataFrame:
    """One ``.npz`` per (embedding_type, chunk) of ``df(embedding_type, chunk, pid, embedding)``;
    returns the written names. The chunk size bounds what a task holds."""
    folder = qualified(df.sparkSession, folder)

    def save(table: pa.Table) -> pa.Table:
        kind, chunk = table["embedding_type"][0].as_py(), table["chunk"][0].as_py()
        name = f"{kind}_embeddings_chunk_{chunk}.npz"
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        buffer = io.BytesIO()
        ids = np.array([str(p) for p in table["pid"].to_pylist()])
        np.savez(buffer, **{VECTORS_KEY: matrix(table["embedding"]).astype("float32"), IDS_KEY: ids})
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(buffer.getvalue())
        return pa.table({"name": [name], "rows": pa.array([table.num_rows], pa.int64())})

    rows = df.select("embedding_type", "chunk", "pid", "embedding")
    return rows.groupBy("embedding_type", "chunk").applyInArrow(save, "name string, rows bigint")
