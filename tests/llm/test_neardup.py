import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import neardup as n
from shelfmark.llm.base import ORACLES, QUERIES
from shelfmark.llm.decontaminate import tokens
from tools.check_oracle import compare, connect

SCHEMA = "doc_id long, text string, class_id string"


@pytest.mark.parametrize("heavy", [2, 50, 5000])
def test_signatures_are_unbiased(heavy):
    rng = np.random.default_rng(heavy)
    e = np.unique(rng.integers(1, 2**63, 50).astype(np.uint64))
    a, b = rng.integers(1, heavy + 1, 50), rng.integers(1, heavy + 1, 50)
    s = n.bag_min_hash([(e, a), (e, b), (e[:0], a[:0])], 8000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025
    assert np.isinf(s[2]).all()


def brute(docs, least=0.8):
    bags = []
    for _, text in docs:
        w = tokens(text or "")
        width = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if w else Counter())
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            total = sum((bags[i] | bags[j]).values())
            if total and sum((bags[i] & bags[j]).values()) >= least * total:
                group[root(i)] = root(j)
    heads = {}
    for i, (ident, _) in enumerate(docs):
        heads.setdefault(root(i), []).append(ident)
    low = {r: min((x for x in ids if x is not None), default=None) for r, ids in heads.items()}
    return sorted(((ident, low[root(i)]) for i, (ident, _) in enumerate(docs)), key=str)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs) * 3, " ".join(copy).upper() if rng.random() < 0.3 else ", ".join(copy)))
    docs += [(9000, None), (9001, ""), (9002, "?!"), (None, docs[0][1]), (None, docs[0][1]), (9003, "one two"), (9004, "One, two!"), (None, "lonely words here"), (7, docs[0][1]), (7, docs[0][1])]
    docs += [(9100 + i, "again and again the same line of words " * k) for i, k in enumerate((50, 52, 20, 400))]
    return docs


def sharing(seed):
    """Texts that are alike in one passage only, of several lengths around it."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    return [(20_000 + i, f"{' '.join(f'o{rng.randrange(9000)}' for _ in range(rng.randint(5, 60)))} {passage}") for i in range(60)]


@pytest.mark.parametrize("block", [1024, 5])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "PER_PIVOT", 3)
    docs = sample(block) + sharing(block)
    frame = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    got = sorted(((r.doc_id, r.class_id) for r in n.near_duplicates(frame).collect()), key=str)
    assert got == brute(docs)


def test_keep_one(spark):
    docs = [(5, "a b c d e f g"), (2, "A b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, None), (None, None), (4, "x")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    out = n.keep_one(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 4, None, None]


def test_long_chain_of_links(spark):
    links = [(i, i + 1) for i in range(200, 0, -1)] + [(500, 501), (501, 502), (502, 500)]
    out = {r.node: r.label for r in n.components(spark.createDataFrame(links, "pivot long, member long")).collect()}
    assert out == {i: 1 for i in range(1, 202)} | {500: 500, 501: 500, 502: 500}


def test_empty_table(spark):
    assert n.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert n.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_same_rows_as_sql(spark):
    where = "/root/testdata/sf0.01"
    verdict, rows = compare(spark, connect(where), where, QUERIES["op5_near_duplicates"], ORACLES["op5_near_duplicates"])
    assert verdict.startswith("ok") and rows > 0, verdict
