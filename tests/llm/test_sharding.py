import numpy as np

from shelfmark.llm.base import QUERIES
from shelfmark.llm.sharding import communication_matrix, random_shards, shard_sizes


def test_matrix_sums_and_law():
    m = communication_matrix([5, 0, 7, 3], 4, seed=1)
    assert m.sum(axis=1).tolist() == [5, 0, 7, 3]
    assert m.sum(axis=0).tolist() == shard_sizes(15, 4).tolist() == [4, 4, 4, 3]
    # A row of the matrix has the hypergeometric mean: 3 of 12 rows for each of 3 shards.
    drawn = np.array([communication_matrix([3, 9], 3, seed=s)[0] for s in range(3000)])
    assert np.allclose(drawn.mean(axis=0), 1, atol=0.06)
    # P(all three rows in shard 0) = C(4,3)/C(12,3)
    assert abs((drawn[:, 0] == 3).mean() - 4 / 220) < 0.01


def test_exact_sizes_and_slots(spark):
    df = spark.range(0, 1003, 1, 7).selectExpr("id AS doc_id", "'x' AS shard", "IF(id % 3 = 0, NULL, 'same') AS text")
    out = random_shards(df, 10, seed=3, rows_per_file=50).collect()
    assert sorted(r.doc_id for r in out) == list(range(1003))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert {k: len(v) for k, v in by.items()} == {j: 101 if j < 3 else 100 for j in range(10)}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = random_shards(df, 10, seed=3, rows_per_file=50).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_order_is_mixed(spark):
    out = random_shards(spark.range(0, 2000, 1, 4).withColumnRenamed("id", "doc_id"), 5, seed=9).collect()
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1
    shards = np.array([r.shard for r in sorted(out, key=lambda r: r.doc_id)])
    assert abs(np.corrcoef(shards, range(2000))[0, 1]) < 0.1


def test_edges(spark):
    schema = "doc_id long, text string"
    assert random_shards(spark.createDataFrame([], schema), 4).collect() == []
    few = random_shards(spark.createDataFrame([(None, None), (None, None), (1, "")], schema), 40).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    out = {r.doc_id: r for r in QUERIES["op10_shards"](spark, data).collect()}
    import zlib

    assert len(out) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        assert (out[d.doc_id]["size"], out[d.doc_id].text_crc32, out[d.doc_id].law) == (len(raw) + 16, zlib.crc32(raw), "rows")
    sizes = np.bincount([r.shard for r in out.values()], minlength=40)
    assert sizes.max() - sizes.min() <= 1
