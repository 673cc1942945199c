"""Uniform random shards of exact size.

A communication matrix says how many rows each stored file sends to each shard. Its rows are
drawn from the multivariate hypergeometric law, so it has the very distribution that a perfect
shuffle of all rows would give it. Each file permutes its rows and deals them out by its row of
the matrix; after the exchange every shard is put in a second random order. Any assignment of
rows to shards and slots that keeps the shard sizes is equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.ranking import global_index
from shelfmark.llm.base import query, stored, table

#: Most cells of the communication matrix that the driver draws (8 bytes each).
MATRIX_CELLS = 32_000_000


def shard_sizes(rows: int, n_shards: int) -> np.ndarray:
    """Sizes at most one apart, the larger ones first."""
    base, extra = divmod(rows, n_shards)
    return np.array([base + (j < extra) for j in range(n_shards)], dtype=np.int64)


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows of each source for each shard: row sums ``counts``, column sums the shard sizes."""
    left = shard_sizes(sum(counts), n_shards)
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for i, n in enumerate(counts):
        matrix[i] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left = left - matrix[i]
    return matrix


def random_shards(df: DataFrame, n_shards: int, seed: int = 20, rows_per_file: int = 1_000_000) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Every row gets a place, repeated rows and rows of NULLs too; equal rows are separate
    rows. An empty table stays empty. Input columns named ``shard`` or ``slot`` are replaced.
    Only the row counts of the files and the matrix pass through the driver: files times
    shards may be ``MATRIX_CELLS`` at most; larger files (``rows_per_file``) make it smaller.
    A task permutes the row numbers of one file, 8 bytes for each of at most ``rows_per_file``.
    The result is the same again for the same input files and seed.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    rows = stored(df.select(kept), "shards", rows_per_file)
    located = rows.select(*kept, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    per_file = sorted((r["_file"], r["n"]) for r in located.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())
    if len(per_file) * n_shards > MATRIX_CELLS:
        raise ValueError("too many files for this number of shards: raise rows_per_file")
    counts = [n for _, n in per_file]
    ends = np.cumsum(communication_matrix(counts, n_shards, seed), axis=1)
    number = {name: i for i, (name, _) in enumerate(per_file)}

    def deal(batches):
        order: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.column("_file").dictionary_encode()
            local = np.array([number[x] for x in names.dictionary.to_pylist()], dtype=np.int64)
            source = local[names.indices.to_numpy(zero_copy_only=False)] if len(local) else np.zeros(0, np.int64)
            at = batch.column("_at").to_numpy(zero_copy_only=False)
            shard = np.zeros(len(at), dtype=np.int32)
            for i in np.unique(source).tolist():
                if i not in order:
                    order = {i: np.random.default_rng([seed, i]).permutation(counts[i])}
                mine = source == i
                shard[mine] = np.searchsorted(ends[i], order[i][at[mine]], side="right")
            keep = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(at), pa.array(source), pa.array(shard)], names=[*kept, "_at", "_source", "shard"])

    fields = [rows.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("_at", T.LongType()), T.StructField("_source", T.LongType()), T.StructField("shard", T.IntegerType())])
    dealt = located.mapInArrow(deal, schema).withColumn("_mix", F.xxhash64(F.lit(seed + 1), "_source", "_at"))
    placed = global_index(dealt, ["shard", "_mix", "_source", "_at"], "_place")
    base, extra = divmod(sum(counts), n_shards)
    start = F.col("shard") * F.lit(base).cast("bigint") + F.least(F.col("shard"), F.lit(extra))
    return placed.withColumn("slot", (F.col("_place") - start).cast("bigint")).drop("_at", "_source", "_mix", "_place")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order over range-cut files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op10_shards")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    out = random_shards(docs, 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
