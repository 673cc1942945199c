import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.ranking import top_k
from shelfmark.operators import ivf, textsearch, textstore, vectorstore
from shelfmark.operators.nearest import BlockSizes
from shelfmark.plans import index_build
from shelfmark.session import pinned, scratch_path
from shelfmark.sources.tables import append_folder, parts, replace_folder


def rows(df, *columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def buckets(df):
    """The bucket folders that a scan reads."""
    plan = df.select(F.input_file_name().alias("file")).distinct().collect()
    return {r.file.split("bucket=")[1].split("/")[0] for r in plan}


def test_replaced_whole_or_not_at_all(spark):
    path = scratch_path(spark, "folder")

    def write(n):
        return lambda folder: spark.range(n).write.parquet(folder)

    def failing(folder):
        write(9)(folder)
        raise OSError("lost")

    with pytest.raises(FileNotFoundError):
        parts(spark, path)
    replace_folder(spark, path, write(3))
    first = parts(spark, path)
    for attempt in (replace_folder, append_folder):
        with pytest.raises(OSError, match="lost"):
            attempt(spark, path, failing)
        assert parts(spark, path) == first and spark.read.parquet(first[0]).count() == 3
    reader = spark.read.parquet(first[0])
    append_folder(spark, path, write(4))
    assert [spark.read.parquet(p).count() for p in parts(spark, path)] == [3, 4]
    replace_folder(spark, path, write(5))
    assert [spark.read.parquet(p).count() for p in parts(spark, path)] == [5]
    assert reader.count() == 3  # who read the old parts can finish
    replace_folder(spark, path, write(6))
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(first[0])


def documents(spark, n=900, seed=2):
    """Common and rare words, and a few documents that are much longer."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda: " ".join(rng.choices(words, weights, k=400 if rng.random() < 0.05 else rng.randrange(1, 12)))
    return pinned(spark.createDataFrame([(i, text()) for i in range(n)] + [(n, None), (n + 1, "")], "pid long, document string"))


QUERIES = [("a", "word0"), ("b", "word0 word1"), ("c", "word3 word0 word9"), ("d", "word50 word0"), ("e", "unknown word0"), ("f", "the"), ("g", None), ("h", "word2 word2")]


@pytest.mark.parametrize("method", ["ts_rank", "ts_rank_cd"])
def test_text_store(spark, monkeypatch, method):
    docs = documents(spark)
    queries = spark.createDataFrame(QUERIES, "query_id string, text string")
    plain = {"ts_rank": textsearch.rank_frequency, "ts_rank_cd": textsearch.rank_cover_density}[method]
    want = rows(top_k(plain(textsearch.text_index(docs), textsearch.parse_queries(queries)), 5), "query_id", "pid", "score", "rank")
    store, ranker = textstore.store_of(docs, buckets=4, block_rows=8), textstore.RANKERS[method]
    out = ["query_id", "pid", "score", "rank"]
    assert {r[0] for r in want} == {"a", "b", "c", "d", "h"}
    assert rows(textstore.search(store, queries, 5, ranker), *out) == want
    monkeypatch.setattr(textstore, "ONE_GO", 0)
    monkeypatch.setattr(textstore, "FIRST_BLOCKS", 1)  # two steps, planned at hand
    assert rows(textstore.search(store, queries, 5, ranker), *out) == want
    read = {r.query_id: r for r in textstore.blocks_read(store, queries, 5, ranker).collect()}
    assert read["a"].scored < read["a"].blocks / 4  # long documents share blocks, so most are skipped
    monkeypatch.setattr(textstore, "SMALL_BLOCKS", 0)  # blocks matched by joins
    assert rows(textstore.search(store, queries, 5, ranker), *out) == want
    monkeypatch.setattr(textstore, "SMALL_QUERIES", 0)  # queries not read first
    assert rows(textstore.search(store, queries, 5, ranker), *out) == want
    assert rows(textstore.blocks_read(store, queries, 5, ranker), "query_id", "blocks", "scored") == sorted(tuple(r) for r in read.values())


def test_text_store_appended(spark, monkeypatch):
    docs = documents(spark)
    queries = spark.createDataFrame(QUERIES, "query_id string, text string")
    path, out = scratch_path(spark, "appended"), ["query_id", "pid", "score", "rank"]
    want = rows(top_k(textsearch.rank_frequency(textsearch.text_index(docs), textsearch.parse_queries(queries)), 5), *out)
    textstore.write_store(docs.filter("pid < 100"), path, 4, 8)
    textstore.append_store(docs.filter("pid < 500"), path)
    textstore.append_store(docs.unionByName(docs), path)
    store = textstore.read_store(spark, path)
    assert store.postings.groupBy("term", "pid").count().filter("count > 1").isEmpty()
    for small in (1000, 0):
        monkeypatch.setattr(textstore, "SMALL_QUERIES", small)
        monkeypatch.setattr(textstore, "ONE_GO", 0)
        assert rows(textstore.search(store, queries, 5, textstore.RANKERS["ts_rank"]), *out) == want


def test_text_store_reads_its_buckets_only(spark):
    store = textstore.store_of(documents(spark), buckets=16, block_rows=8)
    one = spark.createDataFrame([("a", "word1 word0")], "query_id string, text string")
    plan = textstore.search(store, one, 3, textstore.RANKERS["ts_rank"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan
    assert len(buckets(textstore._prepare(store, one, None).postings)) <= 2 < len(buckets(store.postings))


def test_postings_move_packed(spark, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(textstore, "PACKED", 700)
    monkeypatch.setattr(textsearch, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(textsearch, "VOCABULARY", 40)
    words = ["word1", "a", "x" * 7, "y" * 40, "z" * 33]
    seen = spark.createDataFrame([(w,) for w in words], "term string").select(textstore._bucket(F.col("term"), 48)).collect()
    assert [r[0] for r in seen] == textstore._part_of(words, 48).tolist()
    want = textsearch.text_index(docs)
    packed = textstore._packed_postings(docs, textstore._lengths(docs)[0], 4)
    assert packed.count() < want.count() / 20
    store = textstore.store_of(docs, buckets=4, block_rows=8)
    columns = ["term", "pid", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("at")]
    assert rows(store.postings, *columns) == rows(want, *columns)
    maxima = store.postings.groupBy("bucket", "term", "level", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"))
    whole = store.blocks.groupBy("bucket", "term", "level", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"))
    assert rows(whole, *maxima.columns) == rows(maxima, *maxima.columns)


@pytest.mark.parametrize("method", ["ts_rank", "ts_rank_cd"])
def test_large_batches_meet_by_document(spark, monkeypatch, method):
    docs = documents(spark).unionByName(spark.createDataFrame([(1, "word0 word1"), (None, "word0 word1 word2")], "pid long, document string"))  # 1 comes twice
    asked = [(f"{i} {j}", f"word{i} word{j} word{(i * j) % 5}") for i in range(6) for j in range(9)] + QUERIES
    queries, out = spark.createDataFrame(asked, "query_id string, text string"), ["query_id", "pid", "score", "rank"]
    plain = {"ts_rank": textsearch.rank_frequency, "ts_rank_cd": textsearch.rank_cover_density}[method]
    once = docs.filter("pid <> 1")
    want = rows(top_k(plain(textsearch.text_index(once), textsearch.parse_queries(queries)), 3), *out)
    store, ranker = textstore.store_of(docs, buckets=4, block_rows=8), textstore.RANKERS[method]
    monkeypatch.setattr(textstore, "SMALL_QUERIES", 0)
    monkeypatch.setattr(textstore, "PACKED", 300)
    found = textstore.search(store, queries, 3, ranker)
    assert "repartition_by_num" in found._jdf.queryExecution().toString().lower()  # one row for a task and shard
    assert rows(found, *out) == want
    monkeypatch.setattr(textstore, "SENT_TERMS", 0)  # blocks matched by joins
    assert rows(textstore.search(store, queries, 3, ranker), *out) == want


def test_append_reads_ids_alone(spark):
    path, docs = scratch_path(spark, "ids"), documents(spark)
    textstore.write_store(docs.filter("pid < 100"), path, 4, 8)
    store = textstore.read_store(spark, path)
    ids = textstore._ids(spark, path, store.postings)
    assert rows(ids, "pid") == rows(store.postings.select("pid").distinct(), "pid")
    assert all("/ids/" in f for f in ids.inputFiles())
    again = docs.unionByName(docs.filter("pid > 590")).unionByName(spark.createDataFrame([(None, "word0")] * 2, "pid long, document string"))
    textstore.append_store(again, path)
    store = textstore.read_store(spark, path)
    want = docs.unionByName(spark.createDataFrame([(None, "word0")], "pid long, document string"))
    key = ["term", "tf", F.coalesce("pid", F.lit(-1))]
    assert rows(store.postings, *key) == rows(textsearch.text_index(want), *key)
    assert store.n_docs == want.count()
    for text, there in (("the", False), ("The cat", True), ("the-of it's", False), ("", False), ("theory", True), ("été", False), ("étude", True)):
        assert spark.createDataFrame([(text,)], "t string").filter(F.lower("t").rlike(textstore.HAS_TERM)).count() == there, text


def test_empty_text_store(spark):
    store = textstore.store_of(spark.createDataFrame([], "pid string, document string"))
    one = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert textstore.search(store, one, 3, textstore.RANKERS["ts_rank"]).collect() == []
    assert textstore.search(store, one.limit(0), 3, textstore.RANKERS["ts_rank"]).collect() == []


def test_index_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a cat cats"), (1, "cat"), (2, "dog")], "pid long, document string")
    merged = rows(textsearch.text_index(docs, unique_ids=False), "term", "pid", "tf")
    assert merged == [("cat", 1, 3), ("dog", 2, 1)]
    assert rows(textsearch.query_postings(docs.filter("pid = 2"), textsearch.parse_queries(spark.createDataFrame([(1, "dog")], "query_id long, text string"))), "term", "tf") == [("dog", 1)]


def vectors(spark, n=600, width=8, seed=5):
    rng = np.random.default_rng(seed)
    data = [(int(i), [float(x) for x in np.round(rng.normal(size=width), 2)]) for i in range(n)]
    return pinned(spark.createDataFrame(data + [(n, None), (n + 1, [1.0]), (n + 2, [0.0] * width)], "pid long, embedding array<double>"))


def centroids(spark, width=8):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(nlist, c, [float(x) for x in rng.normal(size=width)]) for nlist in (3, 12) for c in range(nlist)], "nlist int, cell int, centroid array<double>")


def test_vector_store(spark):
    v, c = vectors(spark), pinned(centroids(spark))
    queries = v.filter("pid % 60 = 7").select(v.pid.alias("query_id"), "embedding")
    store, out = vectorstore.store_of(v, c, buckets=5), ["query_id", "pid", "score", "rank"]
    posted = pinned(ivf.ivf_assign(v, c))
    for nprobe, nlist in ((1, 12), (4, 12), (12, None), (2, 3)):
        found = ivf.ivf_search(queries, c, posted, 7, nprobe, nlist=nlist)
        cosine = rows(vectorstore.search(store, queries, 7, nprobe, nlist), "query_id", "pid", "cosine")
        want = rows(found, *out)
        for search in (vectorstore.search, vectorstore.search_codes):
            for blocks in (BlockSizes(), BlockSizes(probe_rows=3, vector_rows=50)):
                got = search(store, queries, 7, nprobe, nlist, blocks=blocks)
                assert rows(got, *out) == want, (search, nprobe, nlist)
                assert rows(got, "query_id", "pid", "cosine") == cosine
    exact = {r["query_id"]: r["embedding"] for r in queries.collect()}
    held = {r["pid"]: r["embedding"] for r in v.filter("embedding IS NOT NULL").collect()}
    for r in vectorstore.search(store, queries, 7, 12).collect():
        a, b = np.array(exact[r.query_id]), np.array(held[r.pid])
        assert r.cosine is None and not b.any() or abs(r.cosine - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-9


def test_partitions_read_follow_nprobe(spark):
    v, c = vectors(spark), pinned(centroids(spark))
    store = vectorstore.store_of(v, c, buckets=12)
    one = v.filter("pid = 3").select(v.pid.alias("query_id"), "embedding")
    for nprobe in (1, 4, 12):
        small = vectorstore._probes(store, one, nprobe, 12, BlockSizes())
        read = vectorstore._read(store.cells, 12, sorted({x % 12 for x in small["cell"].to_pylist()}))
        assert len(buckets(read)) == nprobe
    plan = vectorstore.search(store, one, 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(nlist" in plan and "Join" not in plan


def test_codes_kept_by_score_alone(spark):
    v, c = vectors(spark), pinned(centroids(spark))
    store = vectorstore.store_of(v, c, buckets=5)
    queries = v.filter("pid % 30 = 1").select(v.pid.alias("query_id"), "embedding")
    exact = vectorstore.search(store, queries, 10, 12)
    recall = ivf.ivf_recall(exact, vectorstore.search_codes(store, queries, 10, 12, keep=2), ["query_id"], 10)
    assert recall.agg({"recall": "avg"}).first()[0] >= 0.9


def test_vector_store_appended(spark):
    v, c = vectors(spark), pinned(centroids(spark))
    wide = v.filter("pid = 5").selectExpr("pid + 1000 AS pid", "transform(embedding, x -> 100 * x) AS embedding")
    whole = v.unionByName(wide)
    path, queries = scratch_path(spark, "vectors"), v.filter("pid % 60 = 7").select(v.pid.alias("query_id"), "embedding")
    vectorstore.write_store(v.filter("pid < 50"), c, path, 5)
    vectorstore.append_store(v.filter("pid < 300"), path)
    vectorstore.append_store(whole.unionByName(whole), path)
    store = vectorstore.read_store(spark, path)
    want = rows(ivf.ivf_search(queries, c, ivf.ivf_assign(whole, c), 7, 3, nlist=12), "query_id", "pid", "score")
    assert rows(vectorstore.search(store, queries, 7, 3), "query_id", "pid", "score") == want
    assert rows(vectorstore.search_codes(store, queries, 7, 3), "query_id", "pid", "score") == want
    empty = scratch_path(spark, "no-vectors")
    vectorstore.write_store(v.limit(0), c, empty, 5)
    none = vectorstore.read_store(spark, empty)
    assert vectorstore.search(none, queries, 7, 3).collect() == vectorstore.search_codes(none, queries, 7, 3).collect() == []


def test_cells_beyond_the_bound(spark, monkeypatch):
    """Many centroids are matched in blocks: the same cells, with repeated and missing ids."""
    v, c = vectors(spark, 60), pinned(centroids(spark))
    rows_in = v.unionByName(v.filter("pid < 9")).selectExpr("CASE WHEN pid % 7 = 0 THEN NULL ELSE pid END AS pid", "embedding")
    rows_in = rows_in.unionByName(v.filter("pid IN (11, 12)").selectExpr("CAST(10 AS LONG) AS pid", "embedding"))
    want = sorted((tuple(r) for r in ivf.best_cells(rows_in, c, 2).collect()), key=str)
    monkeypatch.setattr(ivf, "MAX_CENTROID_ROWS", 1)
    assert sorted((tuple(r) for r in ivf.best_cells(rows_in, c, 2).collect()), key=str) == want
    store = vectorstore.store_of(v, c, buckets=4)
    assert store.table is None
    queries = v.filter("pid < 5").select(v.pid.alias("query_id"), "embedding")
    found = ivf.ivf_search(queries, c, ivf.ivf_assign(v, c), 3, 2)
    assert rows(vectorstore.search(store, queries, 3, 2), "query_id", "pid", "score") == rows(found, "query_id", "pid", "score")


def test_two_level_training(spark, monkeypatch):
    """Cells of planted groups, the same again, through blocks as well."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 6))
    data = [(i % 200, [float(x) for x in middle[i % 12] + rng.normal(0, 0.02, 6)]) for i in range(360)]  # repeated ids
    v = pinned(spark.createDataFrame(data + [(1000, None), (None, [0.0] * 6)], "pid long, embedding array<double>"))
    trained = ivf.ivf_train_two_level(v, 12, iterations=3, groups=3).orderBy("cell").collect()
    assert [r.cell for r in trained] == list(range(12)) and {r.nlist for r in trained} == {12}
    c = np.array([r.centroid for r in trained])
    assert np.allclose((c * c).sum(axis=1), 1)
    unit = np.array([x for _, x in data]) / np.sqrt((np.array([x for _, x in data]) ** 2).sum(axis=1))[:, None]
    assert (unit @ c.T).max(axis=1).mean() > 0.9
    monkeypatch.setattr(ivf, "MAX_CENTROID_ROWS", 1)
    again = ivf.ivf_train_two_level(v, 12, iterations=3, groups=3).orderBy("cell").collect()
    assert np.allclose([r.centroid for r in again], c)
    with pytest.raises(ValueError, match="needed"):
        ivf.ivf_train_two_level(v, 100)


def test_queries_with_the_same_terms_are_one(spark, monkeypatch):
    docs = documents(spark)
    asked = [("a", "word1 word0"), ("b", "Word0 word1"), ("c", "word3"), ("d", "word3 WORD3")]
    store = textstore.store_of(docs, buckets=4, block_rows=8)
    queries, out = spark.createDataFrame(asked, "query_id string, text string"), ["query_id", "pid", "score", "rank"]
    want = rows(top_k(textsearch.rank_cover_density(textsearch.text_index(docs), textsearch.parse_queries(queries)), 5), *out)
    monkeypatch.setattr(textstore, "SMALL_QUERIES", 0)
    ranker = textstore.RANKERS["ts_rank_cd"]
    assert textstore._prepare(store, queries, ranker).parsed.count() == 2
    assert rows(textstore.search(store, queries, 5, ranker), *out) == want


def test_documents_below_the_kth_score_are_not_looked_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x y x y x y" if i < 3 else "x y y y y y y") for i in range(40)], "pid long, document string")
    store = textstore.store_of(docs, buckets=4, block_rows=1000)
    batch = textstore._prepare(store, spark.createDataFrame([("a", "x y")], "query_id string, text string"), textstore.RANKERS["ts_rank_cd"])
    placed = textstore._placed(batch).withColumn("_least", F.lit(4.5))
    held = textstore._documents(batch, placed, "rest", "_least")
    assert held.count() == 40
    assert {r.pid for r in textstore._reaching(held, textstore.RANKERS["ts_rank_cd"]).collect()} == {0, 1, 2}


def test_cells_of_an_index_fit_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = pinned(spark.createDataFrame([(f"P{i}", rng.normal(size=4).tolist()) for i in range(60)] + [("Z", [0.0] * 4)], "pid string, embedding array<double>"))
    assert index_build._trained(vectors.filter("pid <> 'Z'"), 100, 1).count() == 6
    monkeypatch.setattr(index_build, "ONE_LEVEL_CELLS", 3)
    monkeypatch.setattr(index_build.ivf, "ivf_train", None)  # one k-means of all cells is not made
    assert index_build._trained(vectors, 100, 1).columns == ["nlist", "cell", "centroid"]
    assert index_build._trained(vectors, 5, 1).count() == 5
