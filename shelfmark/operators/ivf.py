"""Clustered vector index as two tables: centroids(nlist, cell, centroid) and
postings(nlist, cell, pid, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import vectors as V
from shelfmark.functions.ranking import global_index, normalize_top, top_k
from shelfmark.operators.nearest import DEFAULT_BLOCKS, SCORE_CELLS, BlockSizes, collect_bounded, matrix, nearest
from shelfmark.schema import SCORE_DECIMALS
from shelfmark.session import pinned, staged

MIN_ROWS_PER_CELL = 10
# Beyond these bounds centroids are matched in blocks instead of travelling to the rows.
MAX_CENTROID_ROWS = 65_536
MAX_CENTROID_BYTES = 512 << 20


def check_training_size(n_rows: int, nlist: int) -> None:
    if n_rows < MIN_ROWS_PER_CELL * nlist:
        raise ValueError(f"{n_rows} vectors cannot train {nlist} cells: {MIN_ROWS_PER_CELL * nlist} needed")


def ivf_train(vectors: DataFrame, nlist: int, seed: int = 42, iterations: int = 10, rows_per_cell: int | None = None) -> DataFrame:
    """Spherical k-means on all vectors: cosine k-means of Spark ML, centroids of length 1.

    ``rows_per_cell`` trains on about that many rows per cell instead, picked by a hash of
    the id, so that the training set is the same on every run. The driver holds the
    ``nlist`` centroids while it trains.
    """
    n_rows = vectors.count()
    check_training_size(n_rows, nlist)
    train = vectors.select("pid", array_to_vector(V.as_double(F.col("embedding"))).alias("features"))
    if rows_per_cell is not None and rows_per_cell * nlist < n_rows:
        train = train.filter(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < int(rows_per_cell * nlist / n_rows * (1 << 30)))
    if nlist == 1:  # one cell around the mean direction
        mean = Summarizer.mean(F.col("features"))
        one = train.agg(F.coalesce(V.l2_normalize(vector_to_array(mean)), vector_to_array(mean)).alias("centroid"))
        return pinned(one.select(F.lit(1).alias("nlist"), F.lit(0).alias("cell"), "centroid"))
    model = KMeans(k=nlist, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(train.select("features"))
    rows = [(nlist, i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "nlist int, cell int, centroid array<double>")


def _spread_out(rows: DataFrame, seed: int) -> DataFrame:
    """``_mix``: an order of the ids that is the same on every run."""
    return rows.withColumn("_mix", F.xxhash64("pid", F.lit(seed)))


def _means(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Lloyd's step: ``assigned(cell, embedding)`` gives each cell its mean, of length 1; a cell that has
    no rows, or whose mean is zero, keeps its place."""
    mean = Summarizer.mean(array_to_vector(V.as_double(F.col("embedding"))))
    new = assigned.groupBy("cell").agg(mean.alias("_m")).select("cell", V.l2_normalize(vector_to_array("_m")).alias("_new"))
    moved = centroids.join(new, "cell", "left").withColumn("centroid", F.coalesce("_new", "centroid"))
    return staged(moved.select(*centroids.columns), "centroids")


def ivf_train_two_level(vectors: DataFrame, nlist: int, seed: int = 42, iterations: int = 5, groups: int | None = None) -> DataFrame:
    """Spherical k-means for more cells than a driver should hold: all centres are tables.

    The vectors are split into about sqrt(nlist) groups by a first k-means, and each group gets
    cells in proportion to its vectors. A vector then meets the centres of its own group only, in
    blocks of bounded size, so a round costs n * sqrt(nlist) products instead of n * nlist, and a
    large group is more blocks. The first centres are vectors in the order of a hash of their id.
    NULL and zero vectors do not train; ids may be repeated.
    """
    unit = vectors.select("pid", V.l2_normalize(F.col("embedding")).alias("embedding")).filter(F.col("embedding").isNotNull())
    rows = staged(_spread_out(unit, seed).withColumn("_row", F.monotonically_increasing_id()), "train")
    check_training_size(rows.count(), nlist)
    n_groups = groups or max(1, round(nlist**0.5))
    by_hash = rows.select("_mix", "_row", F.col("embedding").alias("centroid"))
    upper = global_index(by_hash.orderBy("_mix", "_row").limit(n_groups), ["_mix", "_row"], "_n")
    upper = staged(upper.select(F.lit(n_groups).alias("nlist"), F.col("_n").cast("int").alias("cell"), "centroid"), "groups")
    for _ in range(iterations):
        upper = _means(best_cells(rows.select("_row", "embedding"), upper, 1), upper)
    grouped = best_cells(rows.select("_row", "_mix", "embedding"), upper, 1).select("_row", "_mix", "embedding", F.col("cell").alias("_group"))
    grouped = staged(grouped, "grouped")
    # One centre for each group that has vectors, the rest in the order of the hash.
    first = grouped.groupBy("_group").agg(F.min(F.struct("_mix", "_row")).alias("_f")).select(F.col("_f._row").alias("_row"), F.lit(0).alias("_turn"))
    seeds = grouped.join(first, "_row", "left").withColumn("_turn", F.coalesce("_turn", F.lit(1))).orderBy("_turn", "_mix", "_row").limit(nlist)
    cells = global_index(seeds, ["_turn", "_mix", "_row"], "_n").select(F.col("_n").cast("int").alias("cell"), "_group", F.col("embedding").alias("centroid"))
    cells = staged(cells, "centroids")
    probes = grouped.select(F.col("_row").alias("query_id"), "embedding", F.col("_group").alias("cell"))
    for _ in range(iterations):
        own = cells.select(F.col("cell").alias("pid"), F.col("centroid").alias("embedding"), F.col("_group").alias("cell"))
        best = nearest(own, probes, 1, "ip", cell="cell").select(F.col("query_id").alias("_row"), F.col("pid").alias("cell"))
        cells = _means(grouped.select("_row", "embedding").join(best, "_row"), cells)
    return cells.select(F.lit(nlist).alias("nlist"), "cell", "centroid")


def ivf_seed(vectors: DataFrame, stratum: str, per_stratum: int) -> DataFrame:
    """Centroids without training: the first vectors of each stratum, by id. Repeatable,
    and a start for ``ivf_refine``."""
    order = Window.partitionBy(stratum).orderBy("pid")
    firsts = vectors.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_stratum)
    cell = (F.col(stratum) * per_stratum + F.col("_n") - 1).cast("int")
    seeds = firsts.select(cell.alias("cell"), V.as_double(F.col("embedding")).alias("centroid"))
    total = seeds.agg(F.count(F.lit(1)).cast("int").alias("nlist"))
    return seeds.withColumn("nlist", total.scalar()).select("nlist", "cell", "centroid")


def ivf_refine(vectors: DataFrame, centroids: DataFrame, steps: int = 1) -> DataFrame:
    """Lloyd steps from given centroids; a cell that loses all its rows keeps its place."""
    for _ in range(steps):
        filled = (
            ivf_assign(vectors, centroids)
            .groupBy("nlist", "cell")
            .agg(Summarizer.mean(array_to_vector(V.as_double(F.col("embedding")))).alias("_mean"))
            .select("nlist", "cell", V.l2_normalize(vector_to_array("_mean")).alias("_new"))
        )
        moved = centroids.join(filled, ["nlist", "cell"], "left")
        centroids = pinned(moved.select("nlist", "cell", F.coalesce("_new", "centroid").alias("centroid")))
    return centroids


def best_cells(rows: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """The n best cells by inner product for each row of ``rows(embedding, ...)``, numbered
    from 1 in ``probe``, separately for every ``nlist`` in the centroid table. Equal
    scores: lower cell.

    A centroid table within the bounds travels to the rows, which are not shuffled; a
    larger one is matched with them in blocks (``_best_cells_blocked``).
    """
    centroids = centroids.select("nlist", "cell", "centroid")
    table = collect_bounded(centroids, MAX_CENTROID_ROWS, MAX_CENTROID_BYTES, "centroid")
    if table is None:
        return _best_cells_blocked(rows, centroids, n)
    frame = table.select(["nlist", "cell"]).to_pandas()
    m = matrix(table["centroid"])
    groups = []
    for nlist, part in frame.groupby("nlist"):
        part = part.sort_values("cell")
        groups.append((int(nlist), part["cell"].to_numpy("int32"), m[part.index.to_numpy()]))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(groups)
    rows = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == m.shape[1]))
    at = rows.columns.index("embedding")
    out = T.StructType(
        [*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("nlist", "cell", "probe"))]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(at))
            for nlist, cells, c in shared.value:
                pick = _picked(v, c, n)
                take = np.repeat(np.arange(batch.num_rows), pick.shape[1])
                source = batch if n == 1 else batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [
                        *source.columns,
                        pa.array(np.full(len(take), nlist, "int32")),
                        pa.array(cells[pick.ravel()]),
                        pa.array(np.tile(np.arange(1, pick.shape[1] + 1, dtype="int32"), batch.num_rows)),
                    ],
                    names=[*batch.schema.names, "nlist", "cell", "probe"],
                )

    return rows.mapInArrow(assign, out)


def _picked(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The columns of the n best cells of each row, best first. Scored in slices of ``SCORE_CELLS``, as a batch of
    rows against many cells is a matrix of gigabytes."""
    step, picks = max(1, SCORE_CELLS // max(1, len(c))), []
    for at in range(0, len(v), step):
        key = np.round(v[at : at + step] @ c.T, SCORE_DECIMALS)
        picks.append(key.argmax(axis=1)[:, None] if n == 1 else np.argsort(-key, axis=1, kind="stable")[:, :n])
    return np.concatenate(picks)


def _best_cells_blocked(rows: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """The same for any number of centroids: rows are the probes of ``nearest``, one run for
    each ``nlist``. Rows are numbered, so ids may be repeated or missing."""
    rows, out = pinned(rows.withColumn("_at", F.monotonically_increasing_id())), None
    probes = rows.select(F.col("_at").alias("query_id"), "embedding")
    for nlist in sorted(r["nlist"] for r in centroids.select("nlist").distinct().collect()):
        cells = centroids.filter(F.col("nlist") == nlist).select(F.col("cell").alias("pid"), F.col("centroid").alias("embedding"))
        found = nearest(cells, probes, n, "ip")
        best = found.select(F.col("query_id").alias("_at"), F.lit(nlist).cast("int").alias("nlist"), F.col("pid").alias("cell"), F.col("rank").alias("probe"))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return rows.select(*(c for c in rows.columns if c != "_at"), *(F.lit(0).alias(c) for c in ("nlist", "cell", "probe"))).limit(0)
    return rows.join(out, "_at").select(*(c for c in rows.columns if c != "_at"), "nlist", "cell", "probe")


def ivf_assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Postings: every vector with its best cell."""
    return best_cells(vectors.select("pid", "embedding"), centroids, 1).drop("probe")


def _address(nlist, cell):
    return F.shiftleft(nlist.cast("bigint"), 32) + cell


def ivf_search(
    queries: DataFrame,
    centroids: DataFrame,
    postings: DataFrame,
    k: int,
    nprobe: int,
    blocks: BlockSizes = DEFAULT_BLOCKS,
    nlist: int | None = None,
) -> DataFrame:
    """Top-k by inner product among the vectors of each query's ``nprobe`` best cells.
    Fewer than k rows come back when those cells hold fewer.

    An index may hold several clusterings: ``nlist`` names the one to search, by default
    the finest. Only its centroids and postings are read.
    """
    if nlist is None:
        nlist = centroids.agg(F.max("nlist").alias("n")).first()["n"] or 0
    probes = best_cells(queries.select("query_id", "embedding"), centroids.filter(F.col("nlist") == nlist), nprobe)
    return nearest(postings.filter(F.col("nlist") == nlist), probes, k, "ip", cell="cell", blocks=blocks)


def ivf_sweep(
    queries: DataFrame,
    centroids: DataFrame,
    postings: DataFrame,
    k: int,
    nprobes: list[int],
    blocks: BlockSizes = DEFAULT_BLOCKS,
) -> DataFrame:
    """Every (nlist, nprobe) setting in one job: the tables hold all nlist values, and a
    query has one probe row per cell. Returns ``nlist, nprobe`` with each row."""
    widest = best_cells(queries.select("query_id", "embedding"), centroids, max(nprobes))
    steps = F.array(*[F.lit(p) for p in sorted({int(p) for p in nprobes})])
    # A cell is scored once, for the least nprobe that reaches it; wider settings take its rows over.
    probes = widest.withColumn("nprobe", F.array_min(F.filter(steps, lambda p: p >= F.col("probe")))).select(
        F.to_json(F.struct("nlist", "nprobe", "query_id")).alias("query_id"),
        "embedding",
        _address(F.col("nlist"), F.col("cell")).alias("cell"),
    )
    stored = postings.withColumn("cell", _address(F.col("nlist"), F.col("cell")))
    found = nearest(stored, probes, k, "ip", cell="cell", blocks=blocks)
    original = T._parse_datatype_string(f"nlist int, nprobe int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    tiers = found.withColumn("_run", F.from_json("query_id", original)).select("_run.*", "pid", "score")
    settings = tiers.withColumn("nprobe", F.explode(F.filter(steps, lambda p: p >= F.col("nprobe"))))
    return top_k(settings, k, by=("nlist", "nprobe", "query_id"))


def search_rescored(found: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the found rows on stored vectors, divided by the best when positive."""
    from shelfmark.operators.vectors import rescore_cosine

    return normalize_top(rescore_cosine(found, queries, vectors), style="vector")


def append_vectors(postings: DataFrame, new: DataFrame, centroids: DataFrame) -> DataFrame:
    """Postings for unseen ids only; centroids stay as they are."""
    unseen = new.join(postings.select("pid"), "pid", "left_anti").dropDuplicates(["pid"])
    return ivf_assign(unseen, centroids)


def verify_index(vectors: DataFrame, centroids: DataFrame, postings: DataFrame, nprobe: int = 1, floor: float = 0.99) -> DataFrame:
    """Does every vector find itself (or an equal)? The rest are mismatches. The index is
    taken to hold unit vectors, as the inner product is read as a similarity.

    A vector whose stored posting lies in its best cell and matches it finds itself, which
    one join by id shows; only the others are searched.
    """
    probes = vectors.select(F.col("pid").alias("query_id"), V.l2_normalize(F.col("embedding")).alias("embedding"))
    nlist = centroids.agg(F.max("nlist").alias("n")).first()["n"] or 0
    centroids, postings = centroids.filter(F.col("nlist") == nlist), postings.filter(F.col("nlist") == nlist)
    held = postings.select(F.col("pid").alias("query_id"), "cell", F.col("embedding").alias("_stored"))
    finds = F.coalesce(V.dot(F.col("embedding"), F.col("_stored")) >= floor, F.lit(False))
    found = best_cells(probes, centroids, 1).join(held, ["query_id", "cell"]).filter(finds).select("query_id")
    rest = pinned(probes.join(found, "query_id", "left_anti"))
    again = ivf_search(rest, centroids, postings, 1, nprobe, nlist=nlist).filter(F.col("score") >= floor)
    missed = rest.join(again.select("query_id"), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("mismatches"))
    total = probes.agg(F.count(F.lit(1)).alias("checked"))
    return total.select("checked", missed.scalar().alias("mismatches"), (missed.scalar() == 0).alias("ok"))


def ivf_recall(exact: DataFrame, found: DataFrame, by: list[str], k: int) -> DataFrame:
    """Share of the exact top-k that the clustered search found."""
    truth = exact.filter(F.col("rank") <= k).select("query_id", "pid")
    hits = found.filter(F.col("rank") <= k).join(truth.withColumn("_hit", F.lit(1)), ["query_id", "pid"], "left")
    return hits.groupBy(*by).agg((F.count("_hit") / k).alias("recall"))
