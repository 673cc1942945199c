import random

import numpy as np

from shelfmark.llm import decontaminate as d
from shelfmark.llm.base import ORACLES, QUERIES
from tools.check_oracle import compare, connect

DOCS = "doc_id long, text string, score string, item_id string"
RNG = random.Random(8)
WORDS = [f"w{int(RNG.paretovariate(0.7))}" for _ in range(3000)]


def words(n):
    return " ".join(RNG.choices(WORDS, k=n))


ITEMS = [(i, f"{words(RNG.randint(3, 40))}. {words(RNG.randint(1, 20))}.") for i in range(70)]


def test_bounds_lose_no_passage():
    part = d.Part(ITEMS)
    texts = [words(RNG.randint(0, 400)).split() for _ in range(60)] + [d.tokens(f"{words(50)} {t} {words(RNG.randint(0, 90))}") for _, t in ITEMS]
    got = part.retrieve(texts)
    for k, doc in enumerate(texts):
        chunks = [doc[i : i + part.chunk] for i in range(0, len(doc), part.chunk)]
        best = np.zeros(part.weight.shape[1])
        for i, c in enumerate(chunks):
            held = {part.terms[w] for w in c + (chunks[i + 1] if i + 1 < len(chunks) else []) if w in part.terms}
            best = np.maximum(best, part.weight[sorted(held)].sum(axis=0)) if held else best
        for i in range(len(ITEMS)):
            assert ((k, i) in got) == (best[i] >= 1 - 1e-4) or abs(best[i] - 1) < 1e-3
            if (k, i) in got:
                assert abs(got[k, i] - best[i]) < 1e-3


def brute(docs, items):
    out = set()
    for ident, text in docs:
        held = d.shingles(d.tokens(text or ""))
        for item, t in items:
            want = d.shingles(d.tokens(t))
            if want and len(want & held) >= 0.8 * len(want):
                out.add((ident, item))
    return out


def test_against_brute_force(spark):
    docs = [(i, words(RNG.randint(0, 300))) for i in range(60)]
    docs += [(100 + i, f"{words(RNG.randint(0, 200))} {t.upper()}\n{words(30)}") for i, (_, t) in enumerate(ITEMS)]
    docs += [(200 + i, f"{words(9)} {' '.join(w if k % 11 else 'changed' for k, w in enumerate(t.split()))}") for i, (_, t) in enumerate(ITEMS)]
    docs += [(300, None), (301, ""), (302, words(60_000) + " " + ITEMS[3][1]), (None, ITEMS[4][1]), (None, ITEMS[4][1])]
    tests = [*ITEMS, (900, None), (901, ""), (902, "?!"), (None, "never used here at all"), (3, ITEMS[3][1])]
    frame = spark.createDataFrame([(*x, "clash", "clash") for x in docs], DOCS)
    items = spark.createDataFrame(tests, "item_id long, text string")
    rows = d.find_leaks(frame, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, ITEMS)
    assert sum(r.doc_id is None for r in rows) == 2 and all(r.score > 0.5 for r in rows)
    left = d.drop_leaks(frame, items)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, _ in docs if i is not None} - {r.doc_id for r in rows})


def test_answer_column_and_parts(spark, monkeypatch):
    items = spark.createDataFrame([(1, "what is the tallest hill of this flat land", "the small green one by the lake")], "item_id long, text string, answer string")
    both = "what is the tallest hill of this flat land the small green one by the lake"
    docs = spark.createDataFrame([(1, both), (2, "what is the tallest hill of this flat land unknown")], "doc_id long, text string")
    (row,) = d.find_leaks(docs, items).collect()
    assert (row.doc_id, row.question_overlap, row.answer_overlap) == (1, 1.0, 1.0)
    monkeypatch.setattr(d, "SCAN_CHARS", 200)
    many = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.find_leaks(spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id long, text string"), many).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(ITEMS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "some text of five words", "", "")], DOCS)
    assert d.find_leaks(docs, items).collect() == d.find_leaks(full, items).collect() == []
    assert d.drop_leaks(full, items).count() == 1 and d.drop_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_same_rows_as_sql(spark):
    where = "/root/testdata/sf0.01"
    verdict, n = compare(spark, connect(where), where, QUERIES["op7_decontamination"], ORACLES["op7_decontamination"])
    assert verdict.startswith("ok") and n > 0, verdict
