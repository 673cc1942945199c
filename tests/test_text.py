import hashlib
import itertools
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.stemming import english_stem
from shelfmark.functions.text import STOPWORDS, stem
from shelfmark.operators import encode, enrich, profile
from shelfmark.operators import textsearch as ops


def test_stems(spark):
    want = {"ponies": "pony", "eies": "eie", "bees": "bee", "does": "doe", "is": "is", "cases": "case", "glass": "glass", "bus": "bus", "rings": "ring", "gas": "gas", "ring": "ring"}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r["w"]: r["s"] for r in df.withColumn("s", stem(F.col("w"))).collect()} == want


@pytest.fixture(scope="module")
def corpus(spark):
    """Random documents in which `hot` is everywhere."""
    rnd = random.Random(3)
    words = ["red", "blue", "chair", "table", "lamp", "the", "of"]
    docs = [(i, " ".join(["hot"] + [rnd.choice(words) for _ in range(rnd.randint(0, 12))])) for i in range(80)]
    return docs, ops.text_index(spark.createDataFrame(docs, "pid long, document string"))


QUERIES = [(1, "hot red"), (2, "Red CHAIR chairs"), (3, "the of"), (4, "hot"), (5, "unknown red"), (6, "red blue chair lamp"), (7, "")]


def terms(text):
    stems = {"chairs": "chair"}
    return [stems.get(w, w) for w in text.lower().split()]


def brute(docs, score):
    out = {}
    for q, text in QUERIES:
        wanted = sorted({t for t in terms(text) if t not in STOPWORDS})
        for pid, doc in docs:
            places = [(i + 1, t) for i, t in enumerate(terms(doc)) if t in wanted]
            if wanted and {t for _, t in places} == set(wanted):
                out[q, pid] = round(score(wanted, places), 6)
    return out


def frequency(wanted, places):
    return sum(sum(1 / j**2 for j in range(1, 1 + sum(p[1] == t for p in places))) for t in wanted) / len(wanted)


def covers(wanted, places):
    spans = [
        (i, j)
        for i, j in itertools.combinations_with_replacement(range(len(places)), 2)
        if {t for _, t in places[i : j + 1]} == set(wanted)
    ]
    minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(1 / (1 + places[j][0] - places[i][0] - (j - i)) for i, j in minimal)


def rows(df):
    return {(r["query_id"], r["pid"]): round(r["score"], 6) for r in df.collect()}


def test_rankers_are_brute_force(spark, corpus):
    docs, postings = corpus
    parsed = ops.parse_queries(spark.createDataFrame(QUERIES, "query_id int, text string"))
    stats = ops.term_stats(postings)
    assert rows(ops.rank_frequency(postings, parsed)) == pytest.approx(brute(docs, frequency))
    assert rows(ops.rank_cover_density(postings, parsed, stats)) == pytest.approx(brute(docs, covers))
    matched = {(r["query_id"], r["pid"]) for r in ops.match_all_terms(postings, parsed).collect()}
    assert matched == set(brute(docs, frequency)) and {q for q, _ in matched} <= {1, 2, 4, 6}
    ranked = ops.text_topk(ops.rank_frequency(postings, parsed), 3).collect()
    assert all(r["score"] <= 1 for r in ranked) and sum(r["query_id"] == 4 for r in ranked) == 3
    tfidf = ops.rank_tfidf(postings, parsed, F.lit(80), stats)
    assert rows(tfidf)[4, 0] == 0 or rows(tfidf)[4, 0] < 1


def test_ngrams_and_keywords(spark):
    df = spark.createDataFrame([(1, "Red red chair"), (2, "red chair, the end"), (3, None)], "pid long, document string")
    top = [(r["ngram"], r["n"]) for r in enrich.top_ngrams(df, "document", (1, 2), 3).collect()]
    assert top == [("red", 3), ("chair", 2), ("red chair", 2)]
    found = enrich.keyword_extract(df, 2).collect()
    best = {r["pid"]: r["keyword"] for r in found if r["rank"] == 1}
    assert best[1] == "red red chair" and best[2] == "red chair end"


def test_tags(spark):
    df = spark.createDataFrame([("Soft cotton, SOFT; made in USA for men",), (None,)], "d string")
    out = enrich.merge_tags(enrich.extract_tags(df, "d")).collect()
    assert out[0]["tags_material"] == ["cotton", "soft"]
    assert out[0]["all_tags"] == "cotton for men made in usa soft" and out[1]["all_tags"] == ""


def test_samples(spark):
    df = spark.range(2000).withColumnRenamed("id", "pid")
    a = {r[0] for r in enrich.sample_fraction(df, 0.1, ident="pid").collect()}
    assert a == {r[0] for r in enrich.sample_fraction(df.repartition(7), 0.1, ident="pid").collect()} and 120 < len(a) < 280
    assert 100 < enrich.sample_fraction(df, 0.1).count() < 300


def test_keywords_and_encoding_against_plain_counts(spark):
    rng = random.Random(1)
    words = ["red", "lamp", "wood", "desk", "the", "soft", "chair", "x", "oak"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(40)] + [(98, None), (99, "!! 7")]
    df = spark.createDataFrame(docs, "pid long, document string")
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 5
    got = {}
    for r in enrich.keyword_extract(df, 3, (1, 2), 5).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append((r.keyword, r.score))
    vectors = {r.pid: r.embedding for r in encode.encode_text(df, "document", dim=5).collect()}
    for pid, text in docs:
        all_words = re.findall("[a-z0-9]+", text or "")
        counts = [sum(bucket(w) == b for w in all_words) for b in range(5)]
        length = math.sqrt(sum(c * c for c in counts))
        assert vectors.get(pid) == (None if not all_words else pytest.approx([c / length for c in counts]))
        kept = [w for w in re.findall("[a-z]{2,}", text or "") if w != "the"]
        v = [sum(bucket(w) == b for w in kept) for b in range(5)]
        scored = set()
        for n in (1, 2):
            for i in range(len(kept) - n + 1):
                g = [sum(bucket(w) == b for w in kept[i : i + n]) for b in range(5)]
                score = sum(a * b for a, b in zip(g, v)) / math.sqrt(sum(a * a for a in g) * sum(b * b for b in v))
                scored.add((-round(score, 6), " ".join(kept[i : i + n])))
        assert got.get(pid, []) == [(w, pytest.approx(-s)) for s, w in sorted(scored)[:3]]


def test_sketches_of_parts_are_united(spark):
    df = spark.range(40_000).selectExpr("id % 7 AS part", "id % 9000 AS a", "CAST(id AS STRING) AS b", "CAST(NULL AS INT) AS c")
    parts = profile.distinct_sketches(df.filter("part < 3"), ["a", "b", "c"], ["part"])
    rest = profile.distinct_sketches(df.filter("part >= 3"), ["a", "b", "c"], ["part"])
    got = {r.column_name: (r.estimate, r.error) for r in profile.sketched_counts(parts.unionByName(rest)).collect()}
    for column, exact in (("a", 9000), ("b", 40_000), ("c", 0)):
        assert abs(got[column][0] - exact) <= 4 * got[column][1] * exact


def test_english_stems(spark):
    want = {
        "consistency": "consist", "consolatory": "consolatori", "conspiracies": "conspiraci", "knackeries": "knackeri", "knitting": "knit",
        "knives": "knive", "generally": "general", "general": "general", "generate": "generat", "hoping": "hope", "hopping": "hop", "agreed": "agre",
        "feed": "feed", "cries": "cri", "ties": "tie", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "skies": "sky", "dying": "die", "proceed": "proceed",
        "relational": "relat", "rational": "ration", "happy": "happi", "say": "say", "by": "by", "controlling": "control", "youth": "youth",
        "adoption": "adopt", "communism": "communism", "7s": "7s", "a": "a", "analogy": "analog", "sensational": "sensat", "negative": "negat",
    }
    assert {w: english_stem(w) for w in want} == want
    df = spark.createDataFrame([(1, "Knitted hopes, knitting hoped"), (2, None)], "pid long, document string")
    index = {r.term: r.positions for r in ops.text_index(df, stemming="english").collect()}
    assert index == {"knit": [1, 3], "hope": [2, 4]}
    asked = spark.createDataFrame([(1, "the knits hoping KNIT")], "query_id long, text string")
    assert ops.parse_queries(asked, stemming="english").first().terms == ["knit", "hope"]


def test_top_ngrams_with_frequent_words_only(spark, monkeypatch):
    docs = spark.createDataFrame([("red red fox",), ("red fox bird",), ("bird red fox owl",), (None,)], "text string")
    all_ = [("fox", 3), ("red", 4), ("red fox", 3)]
    for limit in (1000, 0):
        monkeypatch.setattr(enrich, "FREQUENT_WORDS", limit)
        assert sorted(tuple(r) for r in enrich.top_ngrams(docs, "text", (1, 2), 3).collect()) == all_
    counted = []
    monkeypatch.setattr(enrich, "FREQUENT_WORDS", 1000)
    monkeypatch.setattr(enrich, "_gram_counts", lambda *a, f=enrich._gram_counts: counted.append(f(*a)) or counted[-1])
    enrich.top_ngrams(docs, "text", (1, 2), 3).collect()
    assert {r.ngram for r in counted[1].collect()} == {"red red", "red fox", "bird red", "fox bird"}


def test_chunks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(ops, "CHUNK_BYTES", 10)
    texts = ["abcdefgh", None, "é" * 3, "", "x" * 50, "y", "z"]
    chunks = list(ops._chunks(pa.array(texts)))
    assert [t for _, c in chunks for t in c] == texts
    assert [at for at, _ in chunks] == [0, 2, 4, 5]
    vocabulary = ops._Vocabulary(frozenset(["the"]), True, None)
    assert vocabulary.ids(["the", "foxes", "foxe", "the", "owl"]).tolist()[0] == -1
    assert sorted(vocabulary.terms) == ["foxe", "owl"]
