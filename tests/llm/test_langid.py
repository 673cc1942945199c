import random
import zlib

import numpy as np

from shelfmark.llm import langid as g
from shelfmark.llm.base import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, held_out string"


def test_presence_is_the_set_of_grams():
    def brute(text):
        letters = ["".join(c if c.isalpha() else " " for c in text.lower())]
        x = " " + " ".join(letters[0].split()) + " "
        return {x[i : i + n] for n in g.ORDERS for i in range(len(x) - n + 1)}

    a, b = "The quick, brown fox; 12 foxes!", "thé  QUICK\nbrown dog"
    for t in (a, b, "", "x", "ß ẞ 中文"):
        assert abs(int(g.presence(t).sum()) - len(brute(t))) <= 2  # colliding buckets
    both = int((g.presence(a) & g.presence(b)).sum())
    assert abs(both - len(brute(a) & brute(b))) <= 2


def test_kernel_is_normalised():
    rows = np.stack([g.presence(t) for t in ("hello world", "hello there", "")]).astype(np.float32)
    k = g.kernel(rows, rows)
    assert np.allclose(np.diag(k), 1) and np.allclose(k, k.T) and 0 < k[0, 1] < 1


def corpus(rng, n):
    syllables = {"aa": "ka lo mi nu".split(), "bb": "sch ein ung tz".split(), "cc": "eau oux ier que".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(2, 400))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(random.Random(3), 600)
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 % 34", "bb"), (1003, "kalo " * 40_000, None), (None, "einung tzsch ein", None), (None, "einung tzsch ein", None)]
    frame = spark.createDataFrame([(*r, "s", "clash", "clash") for r in rows], SCHEMA)
    out = g.predict_languages(frame, per_language=60).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:600] if got[i].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.98
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out)
    # What is held out has no part in the model: other labels there change nothing.
    other = [(i, t, "cc" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    again = g.predict_languages(spark.createDataFrame([(*r, "t", "x", "x") for r in other], SCHEMA), per_language=60).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 4)) for r in again} == {(r.doc_id, r.lang_pred, round(r.score, 4)) for r in out}


def test_nothing_learnt(spark):
    assert g.predict_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = g.predict_languages(spark.createDataFrame([(1, "some text", None, "s", "", "")], SCHEMA)).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_query(spark):
    where = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    out = QUERIES["op4_language"](spark, where).collect()
    assert len(out) == len(lang)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out if r.held_out]) > 0.97
