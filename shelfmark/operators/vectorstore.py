"""Clustered vectors stored for search, whole and as codes of one byte per component.

Cells are grouped in buckets, which are folders, so a search reads the folders of the cells that it
probes and no others, whatever the number of probes. A cell is kept twice: as rows with their
vectors, and as lists of codes, an eighth of the size. A search over codes folds each query into a
weight per component, so scoring a list is one matrix product over its bytes; as a code is off by
half a step at most, the score is off by a known amount, and only what the k best
cannot exclude is scored again on the vectors. That makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import vectors as V
from shelfmark.functions.ranking import top_k
from shelfmark.operators import ivf
from shelfmark.operators.nearest import DEFAULT_BLOCKS, BlockSizes, collect_bounded, matrix, nearest, result_schema, scan
from shelfmark.operators.quantize import LEVELS
from shelfmark.schema import SCORE_DECIMALS
from shelfmark.session import pinned, scratch_path, staged
from shelfmark.sources.tables import append_folder, parts, read_parts, replace_folder

BUCKETS = 256
#: Vectors of a code list.
LIST_ROWS = 4096
#: Survivors up to which they are sent to the vectors.
SENT_ROWS = 500_000
#: Scores of doubles differ by less than this share from what the bound assumes.
ROUNDING = 1e-9


@dataclass
class VectorStore:
    centroids: DataFrame  # nlist, cell, centroid
    cells: DataFrame  # cell, pid, embedding, nlist, bucket
    #: For each part: cell, pids, codes, nlist, bucket, and the ends of each component.
    codes: list[tuple[DataFrame, np.ndarray, np.ndarray]]
    buckets: int
    finest: int
    table: pa.Table | None  # the centroids, where they are within the bounds


def _lists(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Rows that come sorted by cell as code lists ``nlist, bucket, cell, pids, codes``."""
    kind = rows.schema["pid"].dataType
    out = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("nlist", "bucket", "cell")] + [T.StructField("pids", T.ArrayType(kind)), T.StructField("codes", T.BinaryType())]
    )
    step = np.where(high > low, (high - low) / LEVELS, 1.0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            changes = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                changes[1:] |= key[1:] != key[:-1]
            starts = np.union1d(np.flatnonzero(changes), np.arange(0, batch.num_rows, LIST_ROWS)).astype(np.int64)
            if not len(starts):
                continue
            codes = np.clip(np.rint((matrix(batch.column(4)) - low) / step), 0, LEVELS).astype(np.uint8)
            ends = np.r_[starts[1:], batch.num_rows]
            pids = pa.ListArray.from_arrays(pa.array(np.r_[starts, batch.num_rows], pa.int32()), batch.column(3))
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts], pa.int32()) for k in keys), pids, pa.array([codes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=out.names)

    return rows.select("nlist", "bucket", "cell", "pid", "embedding").mapInArrow(encode, out)


def write_store(vectors: DataFrame, centroids: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``vectors(pid, embedding)`` under all clusterings of ``centroids`` to ``path``, in place of
    the store that is there, which stays readable until the new one is whole. Vectors that are NULL
    or of another width than the centroids are left out."""
    spark = vectors.sparkSession
    centroids = pinned(centroids.select("nlist", "cell", "centroid"))

    def write(folder: str) -> None:
        centroids.write.parquet(f"{folder}/centroids")
        _write_part(vectors, centroids, folder, buckets)

    replace_folder(spark, path, write)


def _write_part(vectors: DataFrame, centroids: DataFrame, folder: str, buckets: int) -> None:
    """Cells, codes and the facts of a part. A part without vectors has facts without ends."""
    spark = vectors.sparkSession
    placed = ivf.ivf_assign(vectors, centroids).withColumn("embedding", V.as_double(F.col("embedding"))).withColumn("bucket", F.pmod("cell", F.lit(buckets)))
    placed = placed.select("cell", "pid", "embedding", "nlist", "bucket")
    order = ["nlist", "bucket", "cell", "pid"]
    placed.hint("rebalance", "nlist", "bucket").sortWithinPartitions(*order).write.partitionBy("nlist", "bucket").parquet(f"{folder}/cells")
    cells = spark.read.schema(placed.schema).parquet(f"{folder}/cells")
    # Grouped, as the summary of no rows is an error.
    ends = cells.withColumn("_all", F.lit(0)).groupBy("_all").agg(Summarizer.metrics("min", "max").summary(array_to_vector("embedding")).alias("s"), F.count(F.lit(1)).alias("n"))
    row = ends.select(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"), "n").first()
    lo, hi, n = (row["lo"], row["hi"], row["n"]) if row else ([], [], 0)
    facts = [(lo, hi, n, buckets, vectors.schema["pid"].dataType.simpleString())]
    spark.createDataFrame(facts, "lo array<double>, hi array<double>, n bigint, buckets int, pid_type string").write.parquet(f"{folder}/facts")
    _lists(cells.hint("rebalance", "nlist", "bucket").sortWithinPartitions(*order), np.array(lo), np.array(hi)).write.partitionBy("nlist", "bucket").parquet(f"{folder}/codes")


def read_store(spark: SparkSession, path: str) -> VectorStore:
    """The store at ``path``. Centroids within the bounds of ``ivf`` are kept at hand."""
    folders = parts(spark, path)
    centroids = spark.read.parquet(f"{folders[0]}/centroids")
    table = collect_bounded(centroids, ivf.MAX_CENTROID_ROWS, ivf.MAX_CENTROID_BYTES, "centroid")
    finest = max(table["nlist"].to_pylist(), default=0) if table is not None else centroids.agg(F.max("nlist").alias("n")).first()["n"]
    facts = [spark.read.parquet(f"{f}/facts").first() for f in folders]
    pid = facts[0]["pid_type"]
    cells = f"cell int, pid {pid}, embedding array<double>, nlist int, bucket int"
    codes = f"nlist int, bucket int, cell int, pids array<{pid}>, codes binary"
    return VectorStore(
        centroids,
        read_parts(spark, folders, "cells", cells),
        [(spark.read.schema(codes).parquet(f"{f}/codes"), np.array(r["lo"]), np.array(r["hi"])) for f, r in zip(folders, facts) if r["n"]],
        facts[0]["buckets"],
        finest,
        table,
    )


def store_of(vectors: DataFrame, centroids: DataFrame, buckets: int = BUCKETS) -> VectorStore:
    """A store in the session's scratch folder."""
    path = scratch_path(vectors.sparkSession, "vector-store")
    write_store(vectors, centroids, path, buckets)
    return read_store(vectors.sparkSession, path)


def _probes(store: VectorStore, queries: DataFrame, nprobe: int, nlist: int, blocks: BlockSizes) -> pa.Table | None:
    """``query_id, embedding, cell`` of a batch within the bounds, without a job for the centroids."""
    if store.table is None:
        return None
    width = len(store.table["centroid"][0]) if store.table.num_rows else 0
    asked = queries.select("query_id", "embedding").filter(F.size("embedding") == width).limit(blocks.probe_rows // max(1, nprobe) + 1).toArrow()
    if asked.num_rows * nprobe > blocks.probe_rows or asked.nbytes * nprobe > blocks.probe_bytes:
        return None
    mine = store.table.filter(pc.equal(store.table["nlist"], nlist)).sort_by("cell")
    key = np.round(matrix(asked["embedding"]) @ matrix(mine["centroid"]).T, SCORE_DECIMALS) if asked.num_rows else np.zeros((0, mine.num_rows))
    pick = np.argsort(-key, axis=1, kind="stable")[:, :nprobe]
    rows = asked.take(pa.array(np.repeat(np.arange(asked.num_rows), pick.shape[1])))
    return rows.append_column("cell", mine["cell"].take(pa.array(pick.ravel())))


def _read(table: DataFrame, nlist: int, buckets: list[int]) -> DataFrame:
    return table.filter((F.col("nlist") == nlist) & (F.col("bucket").isin(buckets) if buckets else F.lit(False)))


def search(store: VectorStore, queries: DataFrame, k: int, nprobe: int, nlist: int | None = None, blocks: BlockSizes = DEFAULT_BLOCKS) -> DataFrame:
    """Top-k by inner product in the ``nprobe`` best cells of each query, as ``ivf.ivf_search``, with the
    ``cosine`` of each row: ``query_id, pid, score, cosine, rank``.

    The folders of the probed cells are read and no others. Probes within the bounds go to the
    vectors, which are not shuffled; more are matched in blocks.
    """
    nlist = store.finest if nlist is None else nlist
    small = _probes(store, queries, nprobe, nlist, blocks)
    if small is not None:
        buckets = sorted({c % store.buckets for c in small["cell"].to_pylist()})
        vectors = _read(store.cells, nlist, buckets).select("pid", "embedding", "cell")
        return top_k(scan(vectors, small, k, "ip", "cell", *result_schema(queries, vectors, True)), k)
    probes = pinned(ivf.best_cells(queries.select("query_id", "embedding"), store.centroids.filter(F.col("nlist") == nlist), nprobe))
    buckets = sorted(r["bucket"] for r in probes.select(F.pmod("cell", F.lit(store.buckets)).alias("bucket")).distinct().collect())
    return nearest(_read(store.cells, nlist, buckets), probes, k, "ip", cell="cell", blocks=blocks, cosine=True)


def search_codes(store: VectorStore, queries: DataFrame, k: int, nprobe: int, nlist: int | None = None, keep: int | None = None, blocks: BlockSizes = DEFAULT_BLOCKS) -> DataFrame:
    """The same rows by way of the codes: ``query_id, pid, score, cosine, rank``.

    By default everything that the error of the codes does not exclude is scored on its vector, so
    the result is that of ``search``. ``keep`` scores the best ``keep`` times k by code only, which may
    miss some. A batch beyond the bounds is searched on the vectors.
    """
    nlist = store.finest if nlist is None else nlist
    small = _probes(store, queries, nprobe, nlist, blocks)
    if small is None:
        return search(store, queries, k, nprobe, nlist, blocks)
    spark = queries.sparkSession
    buckets = sorted({c % store.buckets for c in small["cell"].to_pylist()})
    ids, owner = _numbered(small["query_id"])
    first = np.zeros(len(ids), dtype=np.int64)
    first[owner] = np.arange(len(owner))
    asked = small["embedding"].take(pa.array(first))
    wanted, kind = k * (keep or 1), store.cells.schema["pid"].dataType
    out = T.StructType(
        [T.StructField("_q", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("pid", kind), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    )
    found = None
    for lists, low, high in store.codes:
        part = _scores(_read(lists, nlist, buckets), low, high, small, owner, matrix(asked), wanted, keep is None, out)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return search(store, queries, k, nprobe, nlist, blocks)
    found = staged(found, "code-scores")
    # Whatever may be as good as the least of the k best surely is.
    order = Window.partitionBy("_q").orderBy(F.col("low").desc())
    kth = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= wanted).groupBy("_q").agg(F.min("low").alias("_least"), F.count(F.lit(1)).alias("_held"))
    floor = kth.select("_q", F.when(F.col("_held") >= wanted, F.col("_least")).alias("_floor"))
    table = spark.createDataFrame(pa.table({"_q": pa.array(np.arange(len(ids))), "query_id": ids, "_embedding": asked}))
    survivors = found.join(floor, "_q").filter(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor"))).join(F.broadcast(table), "_q").select("query_id", "cell", "pid", "_embedding")
    vectors = _read(store.cells, nlist, buckets).select("cell", "pid", "embedding")
    if found.count() <= SENT_ROWS:
        survivors = F.broadcast(survivors)
    pairs = vectors.join(survivors, ["cell", "pid"])
    scored = pairs.select("query_id", "pid", V.dot(F.col("_embedding"), F.col("embedding")).alias("score"), V.cosine(F.col("_embedding"), F.col("embedding")).alias("cosine"))
    return top_k(scored, k)


def _scores(lists: DataFrame, low: np.ndarray, high: np.ndarray, probes: pa.Table, owner: np.ndarray, asked: np.ndarray, wanted: int, exact: bool, out: T.StructType) -> DataFrame:
    """The least and the most that the vectors of the lists can score, without those that the task's
    ``wanted`` best exclude. Inexact ones have one score by code for both."""
    step = np.where(high > low, (high - low) / LEVELS, 0.0)
    # Half a step in each component, what adding up in another order may change, and the rounding of scores.
    slack = (np.abs(asked) * step).sum(axis=1) / 2 + ROUNDING * (1 + np.abs(asked).sum(axis=1) * np.abs([low, high]).max()) + 10.0**-SCORE_DECIMALS
    slack = slack if exact else np.zeros(len(asked))
    groups, m, cells = {}, matrix(probes["embedding"]), probes["cell"].to_numpy()
    for c in np.unique(cells).tolist():
        at = np.flatnonzero(cells == c)
        groups[c] = owner[at], m[at] * step, m[at] @ low
    sent = lists.sparkSession.sparkContext.broadcast((groups, slack))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes_of, slack = sent.value
        best = np.full((len(slack), wanted), -np.inf)
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column(0)[i].as_py()
                q, weights, base = probes_of[cell]
                pids = batch.column(1).slice(i, 1).flatten()
                codes = np.frombuffer(batch.column(2)[i].as_py(), np.uint8).reshape(len(pids), -1)
                score = base[:, None] + weights @ codes.T.astype(np.float64)
                best[q] = -np.partition(-np.hstack([best[q], score]), wanted - 1, axis=1)[:, :wanted]
                r, c = np.nonzero(score + 2 * slack[q][:, None] >= best[q].min(axis=1)[:, None])
                held.append((q[r], cell, pids.take(pa.array(c)), score[r, c]))
        floor = best.min(axis=1) - 2 * slack
        for q, cell, pids, score in held:
            at = np.flatnonzero(score >= floor[q])
            if len(at):
                off = slack[q[at]]
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(np.full(len(at), cell, np.int32)), pids.take(pa.array(at)), pa.array(score[at] - off), pa.array(score[at] + off)], names=out.names)

    mine = F.col("cell").isin(sorted(groups)) if groups else F.lit(False)
    return lists.filter(mine).select("cell", "pids", "codes").mapInArrow(score, out)


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Different ids, and the number of each row's id."""
    coded = column.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def append_store(vectors: DataFrame, path: str) -> None:
    """Add the vectors of ids that the store does not hold yet, as a part of its own; of repeated new
    ids one row is taken. Centroids stay as they are. Components beyond the range of the codes
    widen it for the new part, whose codes have a range of their own.
    """
    spark, store = vectors.sparkSession, read_store(vectors.sparkSession, path)
    known = store.cells.filter(F.col("nlist") == store.finest).select("pid")
    new = vectors.select("pid", "embedding").join(known, "pid", "left_anti").dropDuplicates(["pid"])

    def write(folder: str) -> None:
        _write_part(staged(new, "vectors-new"), pinned(store.centroids), folder, store.buckets)

    append_folder(spark, path, write)
