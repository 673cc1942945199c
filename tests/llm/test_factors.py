import hashlib
import random

import numpy as np
import pytest

from shelfmark.llm import factors as f
from shelfmark.llm.base import QUERIES, WORD


def plain(docs):
    """(id, text) to (words, removed, words left) by looking every window up."""
    first = {}
    parts = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in parts:
        for p in range(len(w) - f.WINDOW + 1):
            key = tuple(w[p : p + f.WINDOW])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in parts:
        cut = set()
        for p in range(len(w) - f.WINDOW + 1):
            if first[tuple(w[p : p + f.WINDOW])] < (float("inf") if i is None else i):
                cut.update(range(p, p + f.WINDOW))
        out.append((i, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut)))
    return sorted(out, key=str)


def same(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = f.drop_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got), key=str) == plain(docs)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 30
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 25, 60]))] for _ in range(25)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        docs.append((rng.randrange(n) if rng.random() < 0.9 else None, "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    same(spark, corpus(seed))


def test_small_pieces(spark, monkeypatch):
    """Chunks, texts and batches of any size give the same; so does any choice of seeds."""
    monkeypatch.setattr(f, "CHUNK_WORDS", 50)
    monkeypatch.setattr(f, "TEXT_WORDS", 7)
    monkeypatch.setattr(f, "COMMON", 1 / 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        same(spark, corpus(3))
        same(spark, [(i, "same words again and again " * 12 + f"tail {i}") for i in range(40)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    long = " ".join(str(i) for i in range(30_000))
    p = " ".join("abcdefghijklm")
    docs = [(1, None), (2, ""), (3, " \n"), (4, p), (4, p), (4, p + " x"), (5, p), (None, p), (None, p + " y"), (0, "a " * 40), (9, "a " * 12), (8, "a " * 13), (7, long), (6, "z " + long)]
    same(spark, docs)
    same(spark, [(None, p), (None, p)])
    same(spark, [])


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "x", "a b", 7, [1])], "doc_id int, seed string, text string, n_words int, spans array<int>")
    r = f.drop_repeats(df).collect()[0]
    assert (r.doc_id, r.seed, r.text, r.n_words, r.n_removed, r.spans) == (1, "x", "a b", 2, 0, [])
    with pytest.raises(TypeError, match="integer"):
        f.drop_repeats(spark.createDataFrame([("1", "x")], "doc_id string, text string"))


def test_phrases_cover_every_window():
    rng = np.random.default_rng(5)
    words, counts = f.word_hashes([" ".join(map(str, rng.integers(0, 40, n))) for n in (0, 5, 13, 14, 300)] + [None])
    found = f.Phrases(words, counts, np.zeros(0, np.uint64))
    assert found.n.sum() == 1 + 2 + 288 and found.n.max() <= f.WINDOW - f.GRAM + 1
    # Equal windows have equal seeds.
    seeds = np.repeat(found.seed, found.n)
    by = {}
    for h, s in zip(found.windows.tolist(), seeds.tolist()):
        assert by.setdefault(h, s) == s


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_substring_dedup"](spark, data).collect()
    want = [(i, n, cut, hashlib.sha256(left.encode()).hexdigest()) for i, n, cut, left in plain(docs)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
