"""Centroid clustering over subvector dictionaries, exact in integers.

Vectors are kept in chunks. In a chunk every block of dimensions is a dictionary of its distinct
subvectors and a code per vector, which loses nothing. A round takes the distances from the
distinct subvectors to the centroids once for each dictionary, and the distance of a vector is
the sum of the entries that its codes name. Only centroids and sums per cluster leave the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.base import query, stored, table

#: Components become floor(SCALE * x).
SCALE = 256
#: Dimensions of a block.
BLOCK = 2
#: Vectors of a chunk, and so the most entries of a dictionary.
CHUNK = 32_768
#: Centroids whose distances are held at once.
TILE = 64
#: Largest integer component: 64 Ki squared differences of it still fit in a long.
LARGEST = 1 << 22
#: Most bytes of centroids that travel to the tasks.
CENTROID_BYTES = 64 << 20


def usable(vector: Column | str, width: int) -> Column:
    """True for vectors with ``width`` components, all of them finite numbers."""
    x = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == width) & finite, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    out = np.floor(np.asarray(values, dtype=np.float64) * SCALE)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: its squared distance may not fit in a long")
    return out.astype(np.int64)


def _encode(vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The dictionaries and the codes of each block of dimensions."""
    books, codes = [], []
    for at in range(0, vectors.shape[1], BLOCK):
        block = vectors[:, at : at + BLOCK]
        key = np.zeros(len(block), dtype=np.int64)
        for column in block.T:  # |component| <= LARGEST, so two of them make one key
            key = key * (2 * LARGEST + 1) + column + LARGEST
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        books.append(block[first])
        codes.append(code.reshape(-1))
    return books, codes


def encoded(vectors: DataFrame, ids: str, vector: str, width: int) -> DataFrame:
    """Chunks ``(ids, books, codes)``: the dictionaries of a chunk one after the other as 32-bit
    integers, and its codes block by block."""
    kind = vectors.schema[ids].dataType
    out = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("books", T.BinaryType()),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            whole = rows.combine_chunks()
            flat = pa.concat_arrays([c.flatten() for c in whole.column(1).chunks])
            books, codes = _encode(integers(flat.to_numpy(zero_copy_only=False)).reshape(-1, width))
            names = pa.concat_arrays(whole.column(0).chunks)
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([[len(b) for b in books]], pa.list_(pa.int32())),
                    pa.array([b"".join(b.astype("<i4").tobytes() for b in books)], pa.binary()),
                    pa.array([b"".join(c.astype("<u2").tobytes() for c in codes)], pa.binary()),
                ],
                names=["ids", "sizes", "books", "codes"],
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= CHUNK:
                whole = pa.Table.from_batches(held)
                yield chunk(whole.slice(0, CHUNK))
                held = whole.slice(CHUNK).to_batches()
        if sum(b.num_rows for b in held):
            yield chunk(pa.Table.from_batches(held))

    return vectors.filter(usable(vector, width)).select(ids, vector).mapInArrow(chunks, out)


def _decoded(sizes: list[int], books: bytes, codes: bytes, n: int, width: int):
    """The blocks of a chunk: first dimension, dictionary, codes."""
    values, places, at = np.frombuffer(books, "<i4"), np.frombuffer(codes, "<u2").reshape(len(sizes), n), 0
    for i, size in enumerate(sizes):
        span = min(BLOCK, width - i * BLOCK)
        yield i * BLOCK, values[at : at + size * span].reshape(size, span).astype(np.int64), places[i]
        at += size * span


def _nearest(blocks: list, n: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number at a tie, and the squared distance."""
    best, where = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    for first in range(0, len(centroids), TILE):
        tile = centroids[first : first + TILE]
        total = np.zeros((n, len(tile)), dtype=np.int64)
        for at, book, code in blocks:
            part = np.zeros((len(book), len(tile)), dtype=np.int64)
            for j in range(book.shape[1]):
                part += (book[:, j, None] - tile[None, :, at + j]) ** 2
            total += part[code]
        near = total.argmin(axis=1)
        distance = total[np.arange(n), near]
        closer = distance < best
        best[closer], where[closer] = distance[closer], near[closer] + first
    return where, best


def _chunks(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        names = batch.column("ids")
        for i in range(batch.num_rows):
            own = names.slice(i, 1).flatten()
            sizes, books, codes = (batch.column(c)[i].as_py() for c in ("sizes", "books", "codes"))
            yield own, list(_decoded(sizes, books, codes, len(own), width))


def _sums(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster``, ``dim``, ``total``, ``n`` over all vectors."""
    sent = chunks.sparkSession.sparkContext.broadcast(centroids)
    width = centroids.shape[1]

    def add(batches):
        c = sent.value
        total, count = np.zeros(c.shape, dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for own, blocks in _chunks(batches, width):
            where, _ = _nearest(blocks, len(own), c)
            order = np.argsort(where, kind="stable")
            present, first = np.unique(where[order], return_index=True)
            for at, book, code in blocks:
                total[present, at : at + book.shape[1]] += np.add.reduceat(book[code[order]], first, axis=0)
            count += np.bincount(where, minlength=len(c))
        live = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(live.astype(np.int32)), pa.array(count[live]), pa.array(list(total[live]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = chunks.mapInArrow(add, "cluster int, n bigint, sums array<bigint>")
    return parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def seeds(vectors: DataFrame, ids: str, vector: str, width: int, k: int, salt: str) -> np.ndarray:
    """The k usable vectors whose ids have the smallest hashes; a NULL id comes last, equal ids go by vector."""
    mixed = F.sha2(F.concat(F.lit(salt), F.col(ids).cast("string")), 256)
    first = vectors.filter(usable(vector, width)).select(mixed.alias("_mix"), F.col(vector).alias("_v")).orderBy(F.col("_mix").asc_nulls_last(), "_v").limit(k)
    return integers([r["_v"] for r in first.collect()]).reshape(-1, width)


def cluster(vectors: DataFrame, k: int, rounds: int, ids: str = "vec_id", vector: str = "embedding", width: int = 64, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """The assignment ``ids, cluster, distance`` of all usable vectors, and the final centroids.

    Vectors of another width, NULL vectors and those with a NULL or non-finite component are
    left out; repeated rows are vectors of their own, NULL ids are kept. Of fewer than k vectors
    each is a centroid; an empty table gives no row. Components beyond ``LARGEST / SCALE``
    raise an error, as their distances do not fit in a long. The driver holds the centroids,
    ``CENTROID_BYTES`` at most, and a task one chunk.
    """
    if k < 1 or k * width * 8 > CENTROID_BYTES:
        raise ValueError("k must be positive and the centroids must fit in CENTROID_BYTES")
    centroids = seeds(vectors, ids, vector, width, k, salt)
    if not len(centroids):
        none = vectors.limit(0).select(ids, F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return none, centroids
    chunks = stored(encoded(vectors, ids, vector, width), "vector-chunks")
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(chunks, centroids).collect():  # k x width numbers
            moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
        centroids = moved
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema[ids].dataType

    def assign(batches):
        for own, blocks in _chunks(batches, width):
            where, best = _nearest(blocks, len(own), sent.value)
            yield pa.RecordBatch.from_arrays([own, pa.array(where.astype(np.int32)), pa.array(best)], names=[ids, "cluster", "distance"])

    out = T.StructType([T.StructField(ids, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return stored(chunks.mapInArrow(assign, out), "vector-clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster_inertia``, ``inertia`` and ``centroid_sha256`` added; a row per cluster is sent to all tasks."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(sums.values()), digest[c]) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")


#: Of the query.
K, ROUNDS, WIDTH = 40, 5, 64


def _sql() -> str:
    distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) AS INTEGER) - 1 AS cluster, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) <= {K})"""
    for i in range(ROUNDS + 1):
        text += f""",
a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, min(struct_pack(distance := {distance}, cluster := cluster)) AS best FROM kept CROSS JOIN c{i} GROUP BY 1, 2, 3)"""
        if i < ROUNDS:
            text += f""",
m{i} AS (
  SELECT cluster, list(CAST(floor(total / n) AS BIGINT) ORDER BY d) AS c FROM (
    SELECT cluster, d, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n
    FROM (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY 1, 2) GROUP BY 1),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
    return (
        text
        + f"""
SELECT vec_id, best.cluster AS cluster, best.distance AS distance,
  CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.cluster"""
    )


@query("op11_centroid_clusters", _sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 40 clusters after five rounds."""
    out, centroids = cluster(table(spark, sf_dir, "embeddings"), K, ROUNDS)
    return with_inertia(out, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
