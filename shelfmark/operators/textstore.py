"""Postings stored for search: term buckets that reads are pruned by, and blocks with maxima.

Terms are hashed into buckets, which are folders. A search reads the folders of its terms
and no others. Documents have a key, made of the class of their length and a hash of their
id, and the postings of a term are cut into blocks by the first bits of that key: the more postings,
the more bits, so a block holds about ``block_rows`` postings whatever the term. As the keys are
the same for all terms, blocks of different terms nest. A small table keeps for each block its
number of postings and its largest count; long documents, which hold the large counts, share blocks.

A top-k search scores a few blocks of the highest bounds, and then only those postings of the rarest
term whose own bound, made of their count and the most that the other terms add in their block, reaches
the k-th score found. The bound of a single term is its score, so nothing is looked up for it. Nothing else leaves the scan, and the result is exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X
from shelfmark.functions.ranking import score_key, top_k
from shelfmark.functions.text import STOPWORDS
from shelfmark.operators import textscore
from shelfmark.operators import textsearch as S
from shelfmark.operators.packed import BLOBS, blobs, by_part, pack
from shelfmark.session import pinned, scratch_path, spread, staged
from shelfmark.sources.tables import append_folder, has_table, parts, read_parts, replace_folder

BUCKETS = 64
BLOCK_ROWS = 128
#: Length classes of documents, from quantiles; they are the first six bits of a key.
CLASSES = 64
KEY_BITS = 63
#: Documents that are scored first, for each result wanted.
FIRST_BLOCKS = 4
#: Batches up to these are planned from their own rows.
SMALL_QUERIES = 1000
SMALL_BLOCKS = 100_000
#: Candidate documents of a batch up to which there is one step only.
ONE_GO = 200_000
#: Terms that are sent to the postings.
SENT_TERMS = 500_000
#: Postings that a task packs at once, and that a part of a bucket holds about; characters of text for each.
PACKED = 1 << 20
TEXT_OF_POSTING = 12
#: New ids that are sent to the documents.
SENT_IDS = 2_000_000
#: What a lowered text with a term has: a word that is no stopword.
HAS_TERM = f"(?:^|[^a-z0-9])(?!(?:{'|'.join(STOPWORDS)})(?:[^a-z0-9]|\\z))[a-z0-9]"
#: Rows that leave a part at once.
OUT_ROWS = 1 << 16


@dataclass
class TextStore:
    postings: DataFrame  # term, pid, tf, positions, block, bucket
    blocks: DataFrame  # term, level, block, n, max_tf, bucket
    buckets: int
    n_docs: int


@dataclass(frozen=True)
class Ranker:
    """How matched postings become scores, and the most that a document of a block can score:
    ``whole`` of the sum of the terms' ``share``, which grows with ``max_tf``, and the number of terms, and not
    above ``cap`` times that number and the least share, where there is a cap. ``alone`` are the scores of counts for
    queries of one term, and ``among`` scores the matches of others in numpy; both as ``score`` does."""

    columns: tuple[str, ...]
    score: Callable[[DataFrame], DataFrame]
    share: Callable[[], Column]
    whole: Callable
    cap: float | None = None
    alone: Callable | None = None
    among: Callable | None = None

    def bound(self, total: Column, least: Column, n: Column) -> Column:
        most = self.whole(total, n) if self.cap is None else F.least(self.whole(total, n), self.cap * n * least)
        return most.cast("double")


RANKERS = {
    "ts_rank": Ranker(("tf",), S.score_frequency, lambda: S.damped_count(F.col("max_tf")), lambda total, n: total / n, None, textscore.damped_counts, textscore.frequency),
    # Minimal covers open at different places, and the last places of all terms but one open none. A cover holds
    # each term; those that hold one place of a term open where some term is last seen before it, n at most.
    "ts_rank_cd": Ranker(("positions",), S.score_cover_density, lambda: F.col("max_tf").cast("double"), lambda total, n: total - n + 1, 1.0, textscore.plain_counts, textscore.cover_density),
}


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _lengths(docs: DataFrame) -> tuple[list[int], int, int]:
    """Lengths between the length classes, the number of documents, and the length of all of them."""
    length = F.coalesce(F.length("document"), F.lit(0))
    quantiles = F.percentile_approx(length, [i / CLASSES for i in range(1, CLASSES)], 10_000)
    found = docs.agg(quantiles.alias("q"), F.count(F.lit(1)).alias("n"), F.sum(length.cast("bigint")).alias("size")).first()
    return list(found["q"] or []), found["n"], found["size"] or 0


def _key() -> Column:
    """The key of a document, from its length class and id."""
    return F.shiftleft(F.col("_class").cast("bigint"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64("pid"), 7))


def _part_of(terms: list[str], parts: int) -> np.ndarray:
    """The parts of terms, as ``_bucket`` makes them: with a multiple of the buckets a part lies in one bucket."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms)).view(np.int64) % parts


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def _packed_postings(docs: DataFrame, cuts: list[int], parts: int) -> DataFrame:
    """Postings of ``docs(pid, document)``, made where a document lies, by parts of terms: ``BLOBS`` of
    the ``terms`` in a part, the number of postings of each, and the postings term by term."""
    stops = frozenset(STOPWORDS)
    length = F.coalesce(F.length("document"), F.lit(0)).alias("length")
    rows = spread(docs.select("pid", "document"), "pid").select("pid", length, F.lower("document").alias("document"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, vocabulary = re.compile(X.WORD).findall, S._Vocabulary(stops, True, None)
        held, part, size = [], np.zeros(0, np.int64), 0

        def flush() -> pa.RecordBatch:
            nonlocal part
            part = np.r_[part, _part_of(vocabulary.terms[len(part) :], parts)]
            term, tf, position = (np.concatenate([h[i] for h in held]) for i in (0, 3, 4))
            pid, cls = (pa.concat_arrays([h[i] for h in held]) for i in (1, 2))
            rank = np.empty(len(part), np.int64)
            rank[np.argsort(part, kind="stable")] = np.arange(len(part))
            order = np.argsort(rank[term], kind="stable")
            ends = np.concatenate([[0], np.cumsum(tf)])
            position = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position)).take(pa.array(order)).flatten()
            term, tf = term[order], tf[order]
            pid, cls, ends = pid.take(pa.array(order)), cls.take(pa.array(order)), np.concatenate([[0], np.cumsum(tf)])
            words, out = pa.array(vocabulary.terms, pa.string()), []
            cuts = [*_changes(part[term]).tolist(), len(term)]
            for a, b in zip(cuts, cuts[1:]):
                runs = _changes(term[a:b])
                counts = np.diff(np.r_[runs, b - a]).astype(np.int32)
                out.append((int(part[term[a]]), pack({
                    "terms": words.take(pa.array(term[a:b][runs])), "counts": pa.array(counts), "pid": pid.slice(a, b - a), "class": cls.slice(a, b - a),
                    "tf": pa.array(tf[a:b]), "positions": position.slice(int(ends[a]), int(ends[b] - ends[a])), "level": pa.array([], pa.int32()),
                })))
            held.clear()
            return blobs(out)

        for batch in batches:
            longer = pa.array(np.searchsorted(cuts, batch.column(1).to_numpy()).astype(np.int8))
            for first, texts in S._chunks(batch.column(2)):
                ids, text, position, starts = S._uses(texts, find, vocabulary)
                if len(starts):
                    at = pa.array(first + text[starts])
                    held.append((ids[starts], batch.column(0).take(at), longer.take(at), np.diff(np.r_[starts, len(ids)]).astype(np.int32), position.astype(np.int32)))
                    size += len(starts)
                if held and (size >= PACKED or vocabulary.full()):
                    yield flush()
                    size = 0
                if vocabulary.full():
                    vocabulary.clear()
                    part = np.zeros(0, np.int64)
        if held:
            yield flush()

    return rows.mapInArrow(run, BLOBS)


def _packed_levels(levels: DataFrame, parts: int) -> DataFrame:
    """``levels(term, level)`` as blobs without postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, none = [], 0, pa.array([], pa.int32())

        def flush() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            part, out = _part_of(rows.column(0).to_pylist(), parts), []
            rows = rows.take(pa.array(np.argsort(part, kind="stable")))
            part.sort()
            cuts = [*_changes(part).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                some = rows.slice(a, b - a)
                out.append((int(part[a]), pack({"terms": some.column(0), "level": some.column(1), "counts": none, "tf": none, "positions": none})))
            held.clear()
            return blobs(out)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= PACKED:
                yield flush()
                size = 0
        if size:
            yield flush()

    return levels.select("term", F.col("level").cast("int").alias("level")).mapInArrow(run, BLOBS)


def _unpacked(packed: DataFrame, pid: T.StructField, block_rows: int | None) -> DataFrame:
    """``term, pid, _class, level, positions`` of packed postings, term by term. A part has all postings of its terms,
    so it knows how many there are and makes the level of it, for blocks of about ``block_rows``; without that, levels come in the blobs, and
    are 0 where none comes."""
    out = T.StructType([T.StructField("term", T.StringType()), pid, T.StructField("_class", T.ByteType()), T.StructField("level", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in by_part(batches):
            given = {t: v for f in found if len(f["level"]) for t, v in zip(f["terms"].to_pylist(), f["level"].to_pylist())}
            found = [f for f in found if len(f["tf"])]
            if not found:
                continue
            words = pa.concat_arrays([f["terms"] for f in found]).dictionary_encode()
            names, number = words.dictionary, words.indices.to_numpy()
            by_name = pc.sort_indices(names).to_numpy()
            rank = np.empty(len(names), np.int64)
            rank[by_name] = np.arange(len(names))
            term = np.repeat(rank[number], np.concatenate([f["counts"].to_numpy() for f in found]))
            names, df = names.take(pa.array(by_name)), np.bincount(term, minlength=len(names))
            if block_rows is None:
                level = np.fromiter((given.get(t, 0) for t in names.to_pylist()), np.int32, len(names))
            else:
                level = np.where(df > block_rows, np.ceil(np.log2(np.maximum(df, 1) / block_rows)), 0).astype(np.int32)
            order = np.argsort(term, kind="stable")
            tf = np.concatenate([f["tf"].to_numpy() for f in found])
            ids, cls = (pa.concat_arrays([f[c] for f in found]) for c in ("pid", "class"))
            places = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf, dtype=np.int64)])), pa.concat_arrays([f["positions"] for f in found]))
            del found, tf
            for a in range(0, len(order), OUT_ROWS):
                some = pa.array(order[a : a + OUT_ROWS])
                at = pa.array(term[order[a : a + OUT_ROWS]])
                yield pa.RecordBatch.from_arrays([names.take(at), ids.take(some), cls.take(some), pa.array(level).take(at), places.take(some).cast(pa.list_(pa.int32()))], names=out.names)

    return packed.sortWithinPartitions("part").mapInArrow(run, out)


def _postings(docs: DataFrame, cuts: list[int], length: int, buckets: int, block_rows: int | None, levels: DataFrame | None = None) -> DataFrame:
    """The stored form of the postings of ``docs``. They move once, packed, to the part that has their term."""
    expected = -(-length // TEXT_OF_POSTING)
    parts = buckets * max(1, -(-expected // (buckets * PACKED)))
    packed = _packed_postings(docs, cuts, parts)
    if levels is not None:
        packed = packed.unionByName(_packed_levels(levels, parts))
    slots = docs.sparkSession.sparkContext.defaultParallelism
    tasks = min(parts, max(slots, -(-expected // PACKED)))
    packed = packed.repartitionById(tasks, F.col("part") % tasks)
    flat = _unpacked(packed, docs.schema["pid"], block_rows).withColumn("_key", _key())
    block = F.expr(f"CASE WHEN level = 0 THEN 0L ELSE shiftright(_key, {KEY_BITS} - level) END")
    return flat.select("term", "pid", F.size("positions").cast("bigint").alias("tf"), "positions", "level", block.alias("block"), _bucket(F.col("term"), buckets).alias("bucket"))


def block_maxima(postings: DataFrame) -> DataFrame:
    """``bucket, term, level, block, n, max_tf`` of postings in their stored order, in the tasks that read them: a
    block that two tasks read has a row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = np.ones(len(batch), np.int64)
            if last is not None:
                batch, n = pa.concat_batches([last.select(batch.schema.names), batch]), np.r_[last.column("n").to_numpy(), n]
            if not len(batch):
                continue
            term, block = batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
            new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
            rows = pa.array(new)
            out = [batch.column(c).take(rows) for c in ("bucket", "term", "level", "block")]
            most = pa.array(np.maximum.reduceat(batch.column("max_tf").to_numpy(), new))
            found = pa.RecordBatch.from_arrays([*out, most, pa.array(np.add.reduceat(n, new))], schema=batch.schema.append(pa.field("n", pa.int64())))
            last = found.slice(len(found) - 1)
            yield found.slice(0, len(found) - 1)
        if last is not None:
            yield last

    rows = postings.select("bucket", "term", "level", "block", F.col("tf").alias("max_tf"))
    return rows.mapInArrow(run, "bucket int, term string, level int, block bigint, max_tf bigint, n bigint")


def _write_part(postings: DataFrame, folder: str) -> None:
    order = ["bucket", "term", "block", "pid"]
    postings.sortWithinPartitions(*order).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
    maxima = block_maxima(postings.sparkSession.read.schema(postings.schema).parquet(f"{folder}/postings"))
    maxima.hint("rebalance", "bucket").sortWithinPartitions(*order[:3]).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/blocks")


def write_store(docs: DataFrame, path: str, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> None:
    """Write the store of ``docs(pid, document)`` to ``path``, in place of the one that is there,
    which stays readable until the new one is whole. Ids have to be unique.

    A bucket is one file, or several where a very common term makes it large, and a file holds
    its terms in order.
    """
    spark, docs = docs.sparkSession, docs.select("pid", "document")

    def write(folder: str) -> None:
        cuts, n_docs, length = _lengths(docs)
        _write_part(_postings(docs, cuts, length, buckets, block_rows), folder)
        _write_facts(docs, folder, buckets, cuts, n_docs)

    replace_folder(spark, path, write)


def _write_facts(docs: DataFrame, folder: str, buckets: int, cuts: list[int], n_docs: int) -> None:
    """The facts of a part, and the ids of its documents that have terms."""
    facts = docs.sparkSession.range(1).select(F.lit(n_docs).cast("bigint").alias("n_docs")).withColumns(
        {"buckets": F.lit(buckets), "pid_type": F.lit(docs.schema["pid"].dataType.simpleString()), "cuts": F.array(*[F.lit(c) for c in cuts]).cast("array<int>")}
    )
    facts.write.parquet(f"{folder}/facts")
    docs.filter(F.lower("document").rlike(HAS_TERM)).select("pid").write.option("compression", "zstd").parquet(f"{folder}/ids")


def _ids(spark: SparkSession, path: str, postings: DataFrame) -> DataFrame:
    """The ids that a store holds; those of a part that was written without them are taken from its postings."""
    found, pid = [], T.StructType([postings.schema["pid"]])
    for folder in parts(spark, path):
        if has_table(spark, folder, "ids"):
            found.append(spark.read.schema(pid).parquet(f"{folder}/ids"))
        else:
            found.append(spark.read.schema(postings.schema).parquet(f"{folder}/postings").select("pid").distinct())
    return reduce(DataFrame.unionAll, found)


def _rows_of(docs: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` whose ids are in ``new(pid, copies)``, one for each; of no id there is one row too. Texts
    stay where they lie as long as the ids can be sent to them."""

    def having(wanted: Column) -> DataFrame:
        ids = new.filter(wanted & F.col("pid").isNotNull()).select("pid")
        return docs.join(F.broadcast(ids) if n <= SENT_IDS else ids, "pid", "left_semi")

    several = F.col("copies") > 1
    rows = having(~several)
    if new.filter(several | F.col("pid").isNull()).isEmpty():
        return rows
    return rows.unionByName(staged(having(several).unionByName(docs.filter(F.col("pid").isNull())).dropDuplicates(["pid"]), "text-repeated"))


def append_store(docs: DataFrame, path: str) -> None:
    """Add the documents whose ids the store does not hold yet, as a part of its own; of repeated new ids
    one row is taken. A document without terms leaves no trace, so it may be counted again.

    Length classes and the levels of terms stay those of the store, so blocks still nest; they
    grow with the terms, so a store that has become several times as large should be rewritten.
    """
    spark, store = docs.sparkSession, read_store(docs.sparkSession, path)
    docs, cuts = docs.select("pid", "document"), list(spark.read.parquet(f"{parts(spark, path)[0]}/facts").first()["cuts"])
    new = docs.select("pid").join(_ids(spark, path, store.postings), "pid", "left_anti").groupBy("pid").agg(F.count(F.lit(1)).alias("copies"))

    def write(folder: str) -> None:
        ids = staged(new, "text-new")
        n_docs = ids.count()
        rows = _rows_of(docs, ids, n_docs)
        levels = store.blocks.filter(F.col("level") > 0).select("term", "level").distinct()
        _write_part(_postings(rows, cuts, _lengths(rows)[2], store.buckets, None, levels), folder)
        _write_facts(rows, folder, store.buckets, cuts, n_docs)

    append_folder(spark, path, write)


def read_store(spark: SparkSession, path: str) -> TextStore:
    folders = parts(spark, path)
    facts = read_parts(spark, folders, "facts", "n_docs bigint, buckets int, pid_type string").agg(F.sum("n_docs").alias("n_docs"), F.max("buckets").alias("buckets"), F.max("pid_type").alias("pid_type")).first()
    postings = f"term string, pid {facts['pid_type']}, tf bigint, positions array<int>, level int, block bigint, bucket int"
    blocks = "term string, level int, block bigint, n bigint, max_tf bigint, bucket int"
    return TextStore(
        read_parts(spark, folders, "postings", postings),
        read_parts(spark, folders, "blocks", blocks),
        facts["buckets"],
        facts["n_docs"],
    )


def store_of(docs: DataFrame, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> TextStore:
    """A store in the session's scratch folder, for searches that come with their documents."""
    path = scratch_path(docs.sparkSession, "text-store")
    write_store(docs, path, buckets, block_rows)
    return read_store(docs.sparkSession, path)


@dataclass
class _Search:
    """A batch of queries with what it needs of the store. Queries of a large batch that ask for the same
    terms are one ``query_id`` here, and ``named(query_id, _set)`` tells whose it is."""

    parsed: DataFrame
    terms: DataFrame  # query_id, n_terms, term, bucket
    postings: DataFrame  # of the terms' buckets, or of the terms alone
    candidates: DataFrame  # query_id, n_terms, term, bucket, finer (bits its own blocks have more), block, n, ub, rest (the part of other terms)
    documents: int | None  # in the candidate blocks, where that is known
    named: DataFrame | None = None


def _few(store: TextStore, parsed: DataFrame) -> pa.RecordBatch | pa.Table:
    """The queries of a small batch, or one more than it may have."""
    buckets = F.transform("terms", lambda t: _bucket(t, store.buckets)).alias("_buckets")
    return parsed.select("query_id", "n_terms", "terms", buckets).limit(SMALL_QUERIES + 1).toArrow().combine_chunks()


def _prepare(store: TextStore, queries: DataFrame, ranker: Ranker | None, few: pa.Table | None = None) -> _Search:
    """Queries to candidate blocks: the blocks of each query's rarest term in which all its terms occur,
    with the most that a document there can score.

    A batch within ``SMALL_QUERIES`` is read first: its terms then are literals that the scans
    skip buckets and row groups by, and up to ``SMALL_BLOCKS`` block rows are matched where the
    plan is made. Anything larger is matched by joins; both give the same blocks. Of the
    buckets, one number for each folder, the driver always knows which are read.
    """
    spark, parsed, named = queries.sparkSession, S.parse_queries(queries), None
    share = F.lit(0.0) if ranker is None else ranker.share()
    ranker = ranker or Ranker((), lambda rows: rows, lambda: share, lambda total, n: total)
    few = _few(store, parsed) if few is None else few
    if few.num_rows <= SMALL_QUERIES:
        ids, per_query = few.column("query_id"), few.column("terms").to_pylist()
        words, where = ([x for row in few.column(c).to_pylist() for x in row] for c in ("terms", "_buckets"))
        bucket_of = dict(zip(words, where))
        owner = pa.array([q for q, row in enumerate(per_query) for _ in row], pa.int64())
        parsed = spark.createDataFrame(few.drop_columns(["_buckets"]))
        terms = spark.createDataFrame(pa.table({"query_id": ids.take(owner), "n_terms": few.column("n_terms").take(owner), "term": pa.array(words, pa.string()), "bucket": pa.array(where, pa.int32())}))
        mine = F.col("bucket").isin(sorted(set(where))) & F.col("term").isin(sorted(bucket_of)) if words else F.lit(False)
        postings, blocks = store.postings.filter(mine), store.blocks.filter(mine)
        found = blocks.select("term", "level", "block", "n", share.alias("share")).limit(SMALL_BLOCKS + 1).toArrow()
        if found.num_rows <= SMALL_BLOCKS:
            chosen = _nested(per_query, found.to_pandas(), ranker)
            at, n_terms, least, finer, block, n, ub, rest = (list(c) for c in zip(*chosen)) if chosen else ([],) * 8
            table = pa.table(
                {
                    "query_id": ids.take(pa.array(at, pa.int64())),
                    "n_terms": pa.array(n_terms, pa.int32()),
                    "term": pa.array(least, pa.string()),
                    "bucket": pa.array([bucket_of[t] for t in least], pa.int32()),
                    "finer": pa.array(finer, pa.int32()),
                    "block": pa.array(block, pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "ub": pa.array(ub, pa.float64()),
                    "rest": pa.array(rest, pa.float64()),
                }
            )
            return _Search(parsed, terms, postings, spark.createDataFrame(table), sum(n))
    else:
        named = pinned(parsed.withColumn("terms", F.array_sort("terms")))
        parsed = pinned(named.select("terms", "n_terms").distinct().select(F.monotonically_increasing_id().alias("query_id"), "terms", "n_terms"))
        named = named.join(parsed.select("terms", F.col("query_id").alias("_set")), "terms").select("query_id", "_set")
        terms = parsed.select("query_id", "n_terms", F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), store.buckets))
        used = sorted(r["bucket"] for r in terms.select("bucket").distinct().collect())
        mine = F.col("bucket").isin(used) if used else F.lit(False)
        wanted = terms.select("bucket", "term").distinct()
        postings, blocks = (t.filter(mine).join(wanted, ["bucket", "term"], "left_semi") for t in (store.postings, store.blocks))
    totals = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    met = terms.join(blocks.withColumn("share", share), ["bucket", "term"])
    rarest = F.min(F.struct("df", "term", "level", "bucket")).alias("_least")
    per_query = met.groupBy("query_id", "term", "bucket").agg(F.max("level").alias("level")).join(totals, "term")
    known = per_query.groupBy("query_id").agg(F.count(F.lit(1)).alias("_known"), rarest, F.min("level").alias("_level"))
    # Blocks of the other terms lie inside those of the rarest, which has the fewest bits
    # unless the store was appended to: then those with the fewest bits are taken.
    inside = met.join(known, "query_id").filter(F.col("_known") == F.col("n_terms"))
    coarse = inside.withColumn("block", F.expr("shiftright(block, level - _level)"))
    is_own = F.col("term") == F.col("_least.term")
    own = F.sum(F.when(is_own, F.col("n")))
    per_term = coarse.groupBy("query_id", "n_terms", "_least", "_level", "block", "term").agg(F.max("share").alias("share"), own.alias("n"))
    others = F.coalesce(F.sum(F.when(~is_own, F.col("share"))), F.lit(0.0))
    met_all = per_term.groupBy("query_id", "n_terms", "_least", "_level", "block").agg(F.count(F.lit(1)).alias("_terms"), F.sum("share").alias("_total"), F.min("share").alias("_fewest"), F.sum("n").alias("n"), others.alias("rest"))
    kept = met_all.filter(F.col("_terms") == F.col("n_terms")).withColumn("ub", ranker.bound(F.col("_total"), F.col("_fewest"), F.col("n_terms")))
    chosen = kept.select("query_id", "n_terms", F.col("_least.term").alias("term"), F.col("_least.bucket").alias("bucket"), (F.col("_least.level") - F.col("_level")).alias("finer"), "block", "n", "ub", "rest")
    return _Search(parsed, terms, postings, staged(chosen, "text-candidates"), None, named)


def _nested(queries: list[list[str]], blocks: pd.DataFrame, ranker: Ranker) -> list[tuple]:
    """The same for a small batch: (query number, n_terms, rarest term, finer, block, n, ub, rest)."""
    out = []
    by_term = {t: (int(part["n"].sum()), int(part["level"].iat[0]), part) for t, part in blocks.groupby("term")}
    for q, terms in enumerate(queries):
        if any(t not in by_term for t in terms):
            continue
        rarest, level = min(terms, key=lambda t: (by_term[t][0], t)), min(by_term[t][1] for t in terms)
        totals, held, n, most, fewest = {}, {}, {}, {}, {}
        for term in terms:
            _, own, part = by_term[term]
            for block, share, rows in part.assign(block=part["block"].to_numpy() >> (own - level)).groupby("block").agg(share=("share", "max"), n=("n", "sum")).itertuples():
                totals[block], held[block] = totals.get(block, 0.0) + share, held.get(block, 0) + 1
                fewest[block] = min(share, fewest.get(block, share))
                if term == rarest:
                    n[block], most[block] = int(rows), share
        finer = by_term[rarest][1] - level
        size = len(terms)
        ub = {b: ranker.whole(totals[b], size) if ranker.cap is None else min(ranker.whole(totals[b], size), ranker.cap * size * fewest[b]) for b in totals}
        out += [(q, size, rarest, finer, int(b), n[b], float(ub[b]), float(totals[b] - most[b])) for b in totals if held[b] == size]
    return out


def _documents(batch: _Search, chosen: DataFrame, *more: str) -> DataFrame:
    """``query_id, n_terms, pid, max_tf, *more`` of the documents in the chosen blocks of the rarest terms;
    ``max_tf`` is the count of the rarest term in the document itself."""
    own = F.expr("explode(sequence(shiftleft(block, finer), shiftleft(block + 1, finer) - 1))").alias("block")
    held = batch.postings.select("bucket", "term", "block", "pid", F.col("tf").alias("max_tf"))
    return chosen.select("query_id", "n_terms", "bucket", "term", *more, own).join(held, ["bucket", "term", "block"]).select("query_id", "n_terms", "pid", "max_tf", *more)


def _looked_up(batch: _Search, documents: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The postings of all query terms in these documents, by term and id, which spreads a common term over
    its documents."""
    asked = documents.select("query_id", "n_terms", "pid").join(batch.parsed.select("query_id", "terms"), "query_id")
    asked = asked.select("query_id", "n_terms", "pid", F.explode("terms").alias("term"))
    return asked.join(batch.postings.select("term", "pid", *columns), ["term", "pid"])


def _matched(batch: _Search, chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The postings of the query terms in the documents of the chosen blocks."""
    return _looked_up(batch, _documents(batch, chosen), columns)


def _of_queries(batch: _Search, found: DataFrame) -> DataFrame:
    """Rows of the batch's queries as rows of the queries that were asked."""
    if batch.named is None:
        return found
    return found.withColumnRenamed("query_id", "_set").join(batch.named, "_set").select(*found.columns)


def match_all(store: TextStore, queries: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The matched postings of every document that holds all terms of a query, for ``textsearch``'s scores."""
    batch = _prepare(store, queries, None)
    return _of_queries(batch, _matched(batch, batch.candidates, columns))


def _placed(batch: _Search) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("ub").desc(), "block")
    return batch.candidates.withColumn("_place", F.row_number().over(order))


def _reaches() -> Column:
    """True for blocks whose bound is not below the k-th score found, and where fewer than k were found."""
    return F.col("_least").isNull() | (score_key(F.col("ub") + 1e-9) >= F.col("_least"))


def _first_blocks(k: int) -> int:
    return max(1, -(-FIRST_BLOCKS * k // BLOCK_ROWS))


def _reaching(documents: DataFrame, ranker: Ranker) -> DataFrame:
    """Documents whose own bound, ``ub``, reaches the k-th score: by their count of the rarest term and the most
    that the other terms add in their block."""
    return documents.withColumn("ub", ranker.bound(F.col("rest") + ranker.share(), ranker.share(), F.col("n_terms"))).filter(_reaches())


def _score_alone(documents: DataFrame) -> DataFrame:
    """``query_id, pid, score`` where the bound is the score, as it is for queries of one term."""
    alone = documents.filter(F.col("pid").isNotNull()).groupBy("query_id", "pid").agg(F.count(F.lit(1)).alias("_n"), F.max("ub").alias("score"))
    return alone.filter(F.col("_n") == 1).select("query_id", "pid", "score")


def _kth(found: DataFrame, k: int) -> DataFrame:
    reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min(score_key("score")).alias("_least"))
    return reached.filter(F.col("_n") >= k).select("query_id", "_least")


def _alone(postings: DataFrame, ranker: Ranker, k: int) -> DataFrame:
    """``query_id, pid, score`` of one-term queries, from ``query_id, pid, tf`` in their stored order: the best of what
    each task reads, and a document that comes twice not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
            query, tf = (rows.column(c).to_numpy() for c in (0, 2))
            return rows.take(pa.array(textscore.best_alone(query, rows.column(1), tf, ranker.alone, k)))

        held, best, size = [], [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= PACKED:
                rows = pa.concat_batches(held)
                # Rows of one document are neighbours, so the last ones wait for the next batch.
                last = rows.slice(len(rows) - 1)
                mine = pc.and_(pc.equal(rows.column(0), last.column(0)[0]), pc.equal(rows.column(1), last.column(1)[0]))
                held, best = [rows.filter(mine)], [kept(pa.concat_batches([*best, rows.filter(pc.invert(mine))]))]
                size = len(held[0])
        if size:
            found = kept(pa.concat_batches([*best, *held]))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), pa.array(ranker.alone(found.column(2).to_numpy()))], names=["query_id", "pid", "ub"])

    rows = postings.select("query_id", "pid", "tf")
    out = T.StructType([rows.schema["query_id"], rows.schema["pid"], T.StructField("ub", T.DoubleType())])
    return _score_alone(rows.mapInArrow(run, out))


def _together(postings: DataFrame, sets: textscore.Sets, ranker: Ranker, k: int, shards: int) -> DataFrame:
    """``query_id, pid, score`` of queries of several terms, from ``number, pid, tf`` and positions where the ranker asks
    for them. All postings of a document meet in its shard, packed, and each shard finds its k best for every query."""
    places = "positions" in ranker.columns

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            part = rows.column("part").to_numpy()
            rows = rows.take(pa.array(np.argsort(part, kind="stable")))
            part, out = rows.column("part").to_numpy(), []
            cuts = [*_changes(part).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                some = rows.slice(a, b - a)
                position = some.column("positions").flatten() if places else pa.array([], pa.int32())
                out.append((int(part[a]), pack({"number": some.column("number"), "pid": some.column("pid"), "tf": some.column("tf"), "positions": position})))
            held.clear()
            return blobs(out)

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= PACKED:
                yield flush()
                size = 0
        if held:
            yield flush()

    sent = postings.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in by_part(batches):
            for query_id, pid, score in textscore.searched(found, sent.value, ranker.among, k):
                yield pa.RecordBatch.from_arrays([pa.array(query_id), pid, pa.array(score)], names=["query_id", "pid", "score"])

    of_shard = F.pmod(F.xxhash64("pid"), F.lit(shards)).cast("int").alias("part")
    rows = postings.select("number", "pid", F.col("tf").cast("int").alias("tf"), of_shard, *(["positions"] if places else []))
    out = T.StructType([T.StructField("query_id", T.LongType()), rows.schema["pid"], T.StructField("score", T.DoubleType())])
    packed = rows.mapInArrow(shard, BLOBS).repartitionById(shards, F.col("part"))
    return packed.sortWithinPartitions("part").mapInArrow(run, out)


def _search_large(store: TextStore, parsed: DataFrame, k: int, ranker: Ranker) -> DataFrame | None:
    """The search of a large batch whose terms can be sent to the postings, else None. Queries of one term
    are answered where their postings lie; postings of the others meet by document."""
    spark = parsed.sparkSession
    named = staged(parsed.select("query_id", F.array_sort("terms").alias("terms")), "text-asked")
    sets = staged(named.select("terms").distinct().select(F.monotonically_increasing_id().alias("_set"), "terms"), "text-sets")
    if (sets.agg(F.sum(F.size("terms"))).first()[0] or 0) > SENT_TERMS:
        return None
    known = sets.toArrow().combine_chunks()
    coded = pc.list_flatten(known.column("terms").combine_chunks()).dictionary_encode()
    terms, number, sizes = coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(known.column("terms")).to_numpy()
    ids, several = known.column("_set").to_numpy(), np.repeat(sizes > 1, sizes)
    own, shared = np.full(len(terms), -1, np.int64), np.zeros(len(terms), bool)
    own[number[~several]] = ids[sizes == 1]
    shared[number[several]] = True
    buckets = _part_of(terms.to_pylist(), store.buckets).astype(np.int32)
    asked = spark.createDataFrame(pa.table({"term": terms, "bucket": pa.array(buckets), "number": pa.array(np.arange(len(terms), dtype=np.int32)), "own": pa.array(own), "shared": pa.array(shared)}))

    def of(rows: DataFrame, mine: np.ndarray, wanted: Column, *columns: str) -> DataFrame:
        here = F.col("bucket").isin(np.unique(buckets[mine]).tolist()) if mine.any() else F.lit(False)
        return rows.filter(here).join(F.broadcast(asked.filter(wanted).select("term", *columns)), "term")

    with_id = store.postings.filter(F.col("pid").isNotNull())
    found = _alone(of(with_id, own >= 0, F.col("own") >= 0, "own").withColumnRenamed("own", "query_id"), ranker, k)
    if shared.any():
        n = of(store.blocks, shared, F.col("shared")).agg(F.sum("n")).first()[0] or 0
        slots = spark.sparkContext.defaultParallelism
        asks = textscore.Sets(ids[sizes > 1], number[several], np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1], len(terms))
        found = found.unionByName(_together(of(with_id, shared, F.col("shared"), "number"), asks, ranker, k, max(slots, -(-n // PACKED))))
    best = top_k(found, k).withColumnRenamed("query_id", "_set")
    return best.join(sets, "_set").join(named, "terms").select("query_id", "pid", "score", "rank")


def search(store: TextStore, queries: DataFrame, k: int, ranker: Ranker) -> DataFrame:
    """The k best documents of ``queries(query_id, text)``: ``query_id, pid, score, rank``.

    A query without known terms finds nothing. Scores are compared as everywhere, rounded, then
    by id; a block is left out only where its bound, rounded alike, is below the k-th score.
    Where all candidate blocks hold few documents they are scored in one go. Queries of a large batch
    that have the same terms are searched once, and as long as their terms can be sent to the postings, those are
    read once and move packed, once, to their documents.
    """
    parsed = S.parse_queries(queries)
    few = _few(store, parsed)
    if few.num_rows > SMALL_QUERIES and ranker.among is not None:
        found = _search_large(store, parsed, k, ranker)
        if found is not None:
            return found
    batch = _prepare(store, queries, ranker, few)

    if batch.documents is not None and batch.documents <= ONE_GO:
        return top_k(ranker.score(_matched(batch, batch.candidates, ranker.columns)), k)
    wanted = staged(batch.terms.filter(F.col("n_terms") > 1).select("bucket", "term").distinct(), "text-wanted")
    many = wanted.count() > SENT_TERMS
    terms = replace(batch, postings=batch.postings.join(wanted if many else F.broadcast(wanted), ["bucket", "term"], "left_semi"))

    def scored(blocks: DataFrame) -> DataFrame:
        one = _reaching(_documents(batch, blocks.filter(F.col("n_terms") == 1), "rest", "_least"), ranker)
        several = _reaching(_documents(terms, blocks.filter(F.col("n_terms") > 1), "rest", "_least"), ranker)
        return _score_alone(one).unionByName(ranker.score(_looked_up(terms, several, ranker.columns)))

    placed = _placed(batch)
    first = placed.filter(F.col("_place") <= _first_blocks(k)).withColumn("_least", F.lit(None).cast("double"))
    first = staged(top_k(scored(first), k), "text-first")
    later = placed.filter(F.col("_place") > _first_blocks(k)).join(_kth(first, k), "query_id", "left").filter(_reaches())
    return _of_queries(batch, top_k(first.select("query_id", "pid", "score").unionByName(scored(later)), k))


def blocks_read(store: TextStore, queries: DataFrame, k: int, ranker: Ranker) -> DataFrame:
    """``query_id, blocks, scored``: the candidate blocks of each query, and how many of them a search of
    two steps has to score."""
    batch = _prepare(store, queries, ranker)
    found = ranker.score(_matched(batch, _placed(batch).filter(F.col("_place") <= _first_blocks(k)), ranker.columns))
    open_ = (F.col("_place") <= _first_blocks(k)) | _reaches()
    placed = _placed(batch).join(_kth(top_k(found, k), k), "query_id", "left")
    return _of_queries(batch, placed.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(open_).alias("scored")))
