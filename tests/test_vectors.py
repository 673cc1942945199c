import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import encode, ivf, quantize
from shelfmark.operators import vectors as ops
from shelfmark.operators.nearest import BlockSizes, nearest

SMALL = BlockSizes(probe_rows=7, vector_rows=20)


@pytest.fixture(scope="module")
def cloud(spark):
    """300 vectors; a third of them are copies of one, and some cannot be used."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 16))
    m[:100] = m[0]
    rows = [(i, [float(x) for x in v], i % 5) for i, v in enumerate(m)] + [(900, None, 0), (901, [0.0] * 16, 0)]
    return spark.createDataFrame(rows, "pid long, embedding array<double>, label int"), m


@pytest.fixture(scope="module")
def probes(spark, cloud):
    q = np.random.default_rng(6).normal(size=(20, 16))
    q[0] = cloud[1][0]
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>"), q


def brute(q, m, k, metric="cosine"):
    if metric == "cosine":
        q, m = q / np.linalg.norm(q, axis=1)[:, None], m / np.linalg.norm(m, axis=1)[:, None]
    s = np.round(q @ m.T, 6)
    return {i: sorted(range(len(m)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(q))}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["pid"])
    return out


@pytest.mark.parametrize("blocks", [BlockSizes(), SMALL], ids=["scan", "grid"])
@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_nearest_is_brute_force(cloud, probes, blocks, metric):
    (v, m), (q, qm) = cloud, probes
    want = brute(qm, m, 12, metric)
    got = listed(nearest(v.filter("pid < 900"), q, 12, metric, blocks=blocks))
    assert got == want


def test_unusable_vectors_and_scores(cloud, probes):
    found = ops.knn_exact(probes[0], cloud[0], 400).collect()
    assert {r["pid"] for r in found} == set(range(300))
    best = {}
    for r in found:
        best.setdefault(r["query_id"], []).append(r["score"])
    assert all(max(s) == pytest.approx(1.0) and min(s) <= 1 for s in best.values())


def test_string_ids(spark, cloud, probes):
    v = cloud[0].withColumn("pid", F.format_string("p%04d", "pid"))
    q = probes[0].withColumn("query_id", F.col("query_id").cast("string"))
    a = listed(nearest(v, q, 5))
    assert a == listed(nearest(v, q, 5, blocks=SMALL)) and a["0"][0] == "p0000"


def test_clustered_search(cloud, probes):
    (v, m), (q, qm) = cloud, probes
    v = v.filter("pid < 900")
    centroids = ivf.ivf_seed(v, "label", 2)
    postings = ivf.ivf_assign(v, centroids)
    assert postings.count() == 300
    for blocks in (BlockSizes(), SMALL):
        assert listed(ivf.ivf_search(q, centroids, postings, 12, 10, blocks)) == brute(qm, m, 12, "ip")
    few = [listed(ivf.ivf_search(q, centroids, postings, 12, 2, b)) for b in (BlockSizes(), SMALL)]
    assert few[0] == few[1]
    sweep = ivf.ivf_sweep(q, centroids, postings, 12, [2, 10])
    assert listed(sweep.filter("nprobe = 2")) == few[0]
    recall = {r["nprobe"]: r["recall"] for r in ivf.ivf_recall(nearest(v, q, 12, "ip"), sweep, ["nprobe", "query_id"], 12).groupBy("nprobe").agg(F.avg("recall").alias("recall")).collect()}
    assert recall[10] == pytest.approx(1.0) and recall[2] <= 1


def test_append_in_two_parts(cloud):
    v = cloud[0].filter("pid < 900")
    centroids = ivf.ivf_seed(v, "label", 2)
    once = {(r["pid"], r["cell"]) for r in ivf.ivf_assign(v, centroids).collect()}
    first = ivf.ivf_assign(v.filter("pid < 150"), centroids)
    both = first.unionByName(ivf.append_vectors(first, v, centroids))
    assert {(r["pid"], r["cell"]) for r in both.collect()} == once and both.count() == 300


def test_training(cloud):
    v = ops.l2_normalize(cloud[0].filter("pid < 900"))
    trained = ivf.ivf_train(v, 10, iterations=3)
    assert trained.count() == 10
    assert ivf.verify_index(v, trained, ivf.ivf_assign(v, trained)).first()["ok"]
    with pytest.raises(ValueError):
        ivf.ivf_train(v.limit(5), 10)
    gone = ivf.ivf_assign(v.filter("pid <> 250"), trained)
    assert ivf.verify_index(v, trained, gone, nprobe=10).first()["mismatches"] == 1


def test_refine_is_a_lloyd_step(cloud):
    v, m = cloud[0].filter("pid < 900"), cloud[1]
    seeds = ivf.ivf_seed(v, "label", 1)
    c = {r["cell"]: np.array(r["centroid"]) for r in seeds.collect()}
    cells = np.array([min(c, key=lambda k: (-np.round(x @ c[k], 6), k)) for x in m])
    for r in ivf.ivf_refine(v, seeds).collect():
        mean = m[cells == r["cell"]].mean(axis=0) if (cells == r["cell"]).any() else c[r["cell"]]
        want = mean / np.linalg.norm(mean) if (cells == r["cell"]).any() else mean
        assert np.allclose(r["centroid"], want)


def test_quantisation(cloud, probes):
    v = cloud[0].filter("pid < 900").withColumn("embedding_type", F.lit("image"))
    ranges = quantize.sq8_ranges(v)
    codes = quantize.sq8_encode(v, ranges)
    flat = codes.select(F.explode("code").alias("c")).agg(F.min("c"), F.max("c")).first()
    assert tuple(flat) == (0, 255)
    m = cloud[1]
    step = (m.max(axis=0) - m.min(axis=0)) / 255
    for r in quantize.sq8_decode(codes, ranges).collect():
        assert np.all(np.abs(np.array(r["embedding"]) - m[r["pid"]]) <= step / 2 + 1e-9)
    assert quantize.sq8_search(probes[0], codes, ranges, 3).count() == 60


def test_fusion_and_widths(spark):
    a = spark.createDataFrame([(1, [1.0] * 512), (2, [2.0] * 512)], "pid long, embedding array<double>")
    both = ops.concat_embeddings(a, a)
    assert both.select(F.size("embedding")).first()[0] == 1024
    q = spark.createDataFrame(
        [(1, [3.0, 4.0], None, [1.0]), (2, [3.0, 4.0], None, None), (3, None, [1.0, 0.0], [1.0])],
        "query_id int, image_vec array<double>, image_text_vec array<double>, sentence_vec array<double>",
    )
    got = {r["query_id"]: r["embedding"] for r in ops.fuse_query_embedding(q).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and got[2] == [3.0, 4.0] and len(got[3]) == 3
    types = a.withColumn("embedding_type", F.when(F.col("pid") == 1, "x").otherwise("x")).unionByName(
        spark.createDataFrame([(3, [1.0], "x")], "pid long, embedding array<double>, embedding_type string")
    )
    assert not ops.embedding_dim_check(types).first()["consistent"]
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "pid int, embedding array<double>")
    assert ops.l2_normalize(zero).first()["embedding"] is None


class LengthEncoder:
    def encode(self, batch):
        return [np.array([float(len(t)), 1.0]) if t != "bad" else None for t in batch]


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, "bad"), (4, None)], "pid long, text string")
    got = {r["pid"]: r["embedding"] for r in encode.encode_text(df, "text", LengthEncoder).collect()}
    assert got == {1: [3.0, 1.0]}
    images = spark.createDataFrame([(1, b"P5 2 1\n255\n" + bytes([3, 4])), (2, b"junk")], "pid long, content binary")
    assert [list(r["embedding"]) for r in encode.encode_image(images).collect()] == [[0.6, 0.8]]


def test_scores_of_many_cells_are_made_in_slices(monkeypatch):
    v, c = np.random.default_rng(1).normal(size=(50, 4)), np.random.default_rng(2).normal(size=(30, 4))
    whole = np.argsort(-np.round(v @ c.T, 6), axis=1, kind="stable")
    made = []
    monkeypatch.setattr(ivf, "SCORE_CELLS", 90)
    monkeypatch.setattr(ivf.np, "round", lambda x, d, f=np.round: made.append(x.size) or f(x, d))
    assert (ivf._picked(v, c, 3) == whole[:, :3]).all()
    assert (ivf._picked(v, c, 1) == whole[:, :1]).all()
    assert max(made) <= 90
