import hashlib
import math

import numpy as np
import pytest

from shelfmark.llm import centroids as c
from shelfmark.llm.base import QUERIES


def plain(rows, k, rounds, width):
    """Lloyd's rounds in Python integers: (id, vector) to (id, cluster, distance) and centroids."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, own in groups.items():
            centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centres


def same(spark, rows, k, rounds, width, schema="vec_id long, embedding array<float>"):
    got, centres = c.cluster(spark.createDataFrame(rows, schema), k, rounds, width=width)
    want, means = plain(rows, k, rounds, width)
    assert sorted(((r[0], r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert centres.tolist() == means


def test_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 5)]) for i in rng.permutation(300)]
    same(spark, rows, 7, 4, 5)
    monkeypatch.setattr(c, "CHUNK", 16)  # many chunks, an odd block at the end
    monkeypatch.setattr(c, "TILE", 3)
    same(spark, rows, 7, 4, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [1.0, -1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [0.5, 0.25])]
    same(spark, rows, 3, 2, 2)  # repeated rows, ties, fewer different vectors than clusters
    same(spark, rows, 40, 2, 2)  # fewer vectors than clusters
    same(spark, [], 3, 2, 2)
    same(spark, [("b", [0.0, 0.0]), ("a", [0.1, 0.0]), ("a", [0.3, 0.0])], 2, 2, 2, "vec_id string, embedding array<double>")


def test_beyond_a_long(spark):
    with pytest.raises(Exception, match="may not fit"):
        c.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 2, 1, width=2)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 5, "x")], "vec_id long, embedding array<float>, cluster int, distance string")
    got, _ = c.cluster(df, 2, 1, width=2)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0)]


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, centres = plain(rows, 40, 5, 64)
    got = QUERIES["op11_centroid_clusters"](spark, data).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == total
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
