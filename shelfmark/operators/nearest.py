"""Best-matching vectors for many probes at once, exactly, without pair rows.

Both plans below share one numpy kernel that multiplies a block of probes with a block
of vectors and keeps k rows per probe, so no (probe, vector) pair ever becomes a row
unless it is among the best of its block.

* few probes: the probe matrix is sent to every task and the vectors are scanned where
  they lie, with no shuffle of vectors at all;
* many probes: vectors and probes are cut into hashed blocks of bounded size and every
  vector block meets every probe block of its cell once. A cell that holds a third of
  all vectors is simply more blocks.

Both plans compare vectors of equal length only; ``unmatched_widths`` counts what has no partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.functions.ranking import top_k
from shelfmark.schema import SCORE_DECIMALS
from shelfmark.session import pinned


@dataclass(frozen=True)
class BlockSizes:
    """Bounds on what one task holds."""

    probe_rows: int = 8192
    probe_bytes: int = 64 << 20
    vector_rows: int = 50_000
    cell_table_rows: int = 100_000


DEFAULT_BLOCKS = BlockSizes()
SCORE_CELLS = 4 << 20


def collect_bounded(df: DataFrame, max_rows: int, max_bytes: int, vector: str) -> pa.Table | None:
    """The rows as one Arrow table if they fit both bounds, else None. Sizes are summed on the
    executors first, so nothing beyond the bounds reaches the driver."""
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("values")).first()
    if total["rows"] > max_rows or 8 * total["values"] > max_bytes:
        return None
    return df.toArrow()


def widths(column) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a 2-D double array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    lengths = widths(column)
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, int(lengths[0])).astype(np.float64)


def _prepare(m: np.ndarray, metric: str) -> np.ndarray:
    return m if metric == "ip" else m / _lengths(m)[:, None]


def _lengths(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1))
    length[length == 0] = np.nan
    return length


class _Best:
    """The k best rows per probe seen so far by one task, with the cosine of each where it is asked for."""

    def __init__(self, k: int, probes: int, cosine: bool = False):
        self.k, self.cosine = k, cosine
        self.floor = np.full(probes, -np.inf)
        self.rows = pd.DataFrame({"q": np.zeros(0, "int64"), "pid": [], "key": np.zeros(0), "score": np.zeros(0), "cosine": np.zeros(0)})
        self.waiting: list[pd.DataFrame] = []
        self.waiting_rows = 0

    def match(self, q: np.ndarray, probes: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score in slices, so that the score block stays small next to the inputs."""
        step = max(1, SCORE_CELLS // max(1, len(probes)))
        own = _lengths(probes) if self.cosine else None
        for at in range(0, len(ids), step):
            part = vectors[at : at + step]
            self.offer(q, ids[at : at + step], probes @ part.T, own, _lengths(part) if self.cosine else None)

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray | None, other: np.ndarray | None) -> None:
        key = np.round(scores, SCORE_DECIMALS)
        key[np.isnan(key)] = -np.inf
        cut = self.floor[q]
        if key.shape[1] > self.k:
            cut = np.maximum(cut, np.partition(key, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((key >= cut[:, None]) & (key > -np.inf))
        found = {"q": q[r], "pid": ids[c], "key": key[r, c], "score": scores[r, c]}
        found["cosine"] = scores[r, c] / (own[r] * other[c]) if self.cosine else np.nan
        self.waiting.append(pd.DataFrame(found))
        self.waiting_rows += len(r)
        if self.waiting_rows > 4 * self.k * len(self.floor):
            self.settle()

    def settle(self) -> pd.DataFrame:
        if self.waiting:
            parts = [p for p in [self.rows, *self.waiting] if len(p)]
            if parts:
                both = pd.concat(parts).sort_values(["q", "key", "pid"], ascending=[True, False, True])
                self.rows = both.groupby("q", sort=False).head(self.k)
                full = self.rows.groupby("q")["key"].agg(["size", "min"])
                full = full[full["size"] >= self.k]
                self.floor[full.index.to_numpy()] = full["min"].to_numpy()
            self.waiting, self.waiting_rows = [], 0
        return self.rows


def _emit(best: pd.DataFrame, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
    return pa.table(
        [
            pa.array(query_ids[best["q"].to_numpy("int64")], schema.field(0).type),
            pa.array(best["pid"].to_numpy(), schema.field(1).type),
            *(pa.array(best[f.name].to_numpy("float64"), pa.float64(), from_pandas=True) for f in list(schema)[2:]),
        ],
        schema=schema,
    )


def _objects(column) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist())


def unmatched_widths(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """``side``, ``width`` and number of vectors or probes that ``nearest`` cannot compare, as
    the other side has none of their length; a NULL vector has a NULL width."""

    def sizes(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), F.size("embedding").alias("width")).groupBy("side", "width").agg(F.count(F.lit(1)).alias("n"))

    def alone(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select("width"), "width", "left_anti").select("side", "width", "n")

    v, p = sizes(vectors, "vectors"), sizes(probes, "probes")
    return alone(v, p).unionByName(alone(p, v))


def nearest(
    vectors: DataFrame,
    probes: DataFrame,
    k: int,
    metric: str = "cosine",
    cell: str | None = None,
    blocks: BlockSizes = DEFAULT_BLOCKS,
    cosine: bool = False,
) -> DataFrame:
    """Top-k of ``vectors(pid, embedding[, cell])`` for ``probes(query_id, embedding[, cell])``.

    With ``cell``, a probe row only meets vectors of its own cell, and one query may
    have several probe rows. Returns ``(query_id, pid, score, rank)``. Vectors meet probes
    of their own length; rows without a vector and lengths that only one side has are left
    out (``unmatched_widths`` counts them). ``cosine`` adds the cosine of each row found by inner
    product, NULL for a zero vector, so that nothing has to be looked up to score it again.
    """
    extra = [cell] if cell else []
    vectors = vectors.select("pid", "embedding", *extra).filter(F.col("embedding").isNotNull())
    probes = probes.select("query_id", "embedding", *extra).filter(F.col("embedding").isNotNull())
    out, out_arrow = result_schema(probes, vectors, cosine)

    small = collect_bounded(probes, blocks.probe_rows, blocks.probe_bytes, "embedding")
    if small is not None:
        partial = scan(vectors, small, k, metric, cell, out, out_arrow)
    else:
        # Fresh column identities: probes are often derived from the vectors themselves.
        partial = _grid(vectors, pinned(probes.toDF(*probes.columns)), k, metric, cell, blocks, out, out_arrow)
    return top_k(partial, k)


def result_schema(probes: DataFrame, vectors: DataFrame, cosine: bool = False) -> tuple[T.StructType, pa.Schema]:
    fields = [T.StructField("query_id", probes.schema["query_id"].dataType), T.StructField("pid", vectors.schema["pid"].dataType), T.StructField("score", T.DoubleType())]
    if cosine:
        fields.append(T.StructField("cosine", T.DoubleType()))
    return T.StructType(fields), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


def scan(vectors: DataFrame, table: pa.Table, k: int, metric: str, cell: str | None, out: T.StructType, out_arrow: pa.Schema) -> DataFrame:
    """The k best rows per probe and task; the probes go to the vectors."""
    spark = vectors.sparkSession
    if table.num_rows == 0:
        return spark.createDataFrame([], out)
    query_ids, which = np.unique(_objects(table["query_id"]), return_inverse=True)
    cells = _objects(table[cell]) if cell else np.zeros(table.num_rows, dtype="int8")
    length = widths(table["embedding"])
    groups: dict = {}
    for w in np.unique(length):
        for c in np.unique(cells[length == w]):
            rows = np.nonzero((length == w) & (cells == c))[0]
            groups[c.item() if hasattr(c, "item") else c, int(w)] = (which[rows], _prepare(matrix(table["embedding"].take(pa.array(rows))), metric))
    vectors = vectors.filter(F.size("embedding").isin(sorted({w for _, w in groups})))
    if cell:
        # Other cells do not reach the kernel. What the scan can skip by the list depends on the layout.
        vectors = vectors.filter(F.col(cell).isin(list({c for c, _ in groups})))
    shared = spark.sparkContext.broadcast((groups, query_ids))
    cosine = "cosine" in out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes_of, ids_of = shared.value
        best = _Best(k, len(ids_of), cosine)
        for batch in batches:
            if not batch.num_rows:
                continue
            pids, length = _objects(batch.column(0)), widths(batch.column(1))
            here = _objects(batch.column(2)) if cell else np.zeros(batch.num_rows, dtype="int8")
            for w in np.unique(length):
                for c in np.unique(here[length == w]):
                    found = probes_of.get((c.item() if hasattr(c, "item") else c, int(w)))
                    if found is not None:
                        at = np.nonzero((length == w) & (here == c))[0]
                        best.match(*found, pids[at], _prepare(matrix(batch.column(1).take(pa.array(at))), metric))
        yield from _emit(best.settle(), ids_of, out_arrow).to_batches()

    return vectors.mapInArrow(run, out)


def _grid(vectors, probes, k, metric, cell, blocks, out, out_arrow) -> DataFrame:
    keys = [cell, "_width"] if cell else ["_width"]
    vectors, probes = (df.withColumn("_width", F.size("embedding")) for df in (vectors, probes))

    def splits(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    sizes = pinned(splits(vectors, blocks.vector_rows, "_vs").join(splits(probes, blocks.probe_rows, "_ps"), keys))
    if sizes.count() <= blocks.cell_table_rows:
        sizes = F.broadcast(sizes)
    vectors, probes = vectors.join(sizes, keys), probes.join(sizes, keys)

    def blocked(df: DataFrame, ident: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        return (
            df.filter((F.col(own) > 0) & (F.col(other) > 0))
            .withColumn(own_block, F.pmod(F.xxhash64(ident), F.col(own)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select(*keys, "_vb", "_pb", ident, "embedding")
        )

    left = blocked(vectors, "pid", "_vs", "_ps", "_vb", "_pb").groupBy(*keys, "_vb", "_pb")
    right = blocked(probes, "query_id", "_ps", "_vs", "_pb", "_vb").groupBy(*keys, "_vb", "_pb")

    def block(v: pa.Table, p: pa.Table) -> pa.Table:
        if not v.num_rows or not p.num_rows:
            return out_arrow.empty_table()
        ids_of, owner = np.unique(_objects(p["query_id"]), return_inverse=True)
        best = _Best(k, len(ids_of), "cosine" in out.names)
        probe_m = _prepare(matrix(p["embedding"]), metric)
        pids, m = _objects(v["pid"]), _prepare(matrix(v["embedding"]), metric)
        best.match(owner, probe_m, pids, m)
        return _emit(best.settle(), ids_of, out_arrow)

    return left.cogroup(right).applyInArrow(block, out)
