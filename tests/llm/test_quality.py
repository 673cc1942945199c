from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import quality as q
from shelfmark.llm.base import ORACLES, QUERIES
from tools.check_oracle import compare, connect

SCHEMA = "doc_id long, text string, source string, kept string"


def brute_repeat(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)})


@settings(max_examples=200)
@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeat_words(words):
    assert q.repeat_words(words) == brute_repeat(words)


def test_measure():
    counts, lines = q.measure("one  two#\n\n \t\none  two#\nONE two#\x1cx ä\n")
    assert counts == [7, 3 + 4 + 3 + 4 + 3 + 6 + 1, 3, 1, 0]
    assert sorted(lines.values()) == [3, 4]
    assert q.measure("") == ([0, 0, 0, 0, 0], {})


def brute(rows, line_docs, share):
    split = lambda t: [(" ".join(q.WORD.findall(x)).lower(), len(q.WORD.findall(x))) for x in (t or "").split("\n")]
    held, texts = defaultdict(dict), defaultdict(set)
    for ident, text, host in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        texts[host].add(text)
        for line, n in split(text):
            if n:
                held[host, line].setdefault(text, ident)
    out = []
    for ident, text, host in rows:
        lost = 0
        for line, n in split(text):
            who = held.get((host, line), {})
            if n and len(who) >= line_docs and len(who) > share * len(texts[host]) and text != next(iter(who)):
                lost += n
        words = q.WORD.findall(text or "")
        failed = len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words)
        out.append((ident, len(words), lost, failed, not failed and len(words) - lost >= 10))
    return out


def test_against_brute_force(spark):
    common = "this line is on many pages of the host you see"
    rows = [(i, f"{common}\nown {i} words " + " ".join(f"w{i}x{k}" for k in range(i % 20)), "ab"[i % 2]) for i in range(80)]
    rows += [(100 + i, "copied " + " ".join(map(str, range(30))), "a") for i in range(40)]
    rows += [(200, None, "a"), (201, "", None), (202, "few words", "b"), (203, "a b c d e " * 30_000, "b"), (None, common, "a"), (None, common, "a")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = q.quality(docs, line_docs=5, line_share=0.1).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted([(r.doc_id, r.n_words, r.n_removed_words, r.base_failed, r.kept) for r in out], key=key)
    assert got == sorted(brute(rows, 5, 0.1), key=key)
    assert all(r.kept for r in out if r.doc_id is not None and 100 <= r.doc_id < 140)
    left = q.keep_good(docs, line_docs=5, line_share=0.1)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in out if r.kept)


def test_lines_above_the_limits_leave_the_texts(spark):
    common, own = "this line is on\tmany pages of the one host you see", lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    texts = [f"{own(i)}\n\n{common.upper() if i % 2 else common}\nend {i}" for i in range(20)]
    texts += [f"{common}\n{own(20)[:-14]}", own(21), None]  # the first loses 12 of 22 words
    docs = spark.createDataFrame([(i, t, "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int")
    out = {r.doc_id: r for r in q.keep_clean(docs, line_docs=5).collect()}
    wanted = {i: texts[i] if i in (0, 21) else f"{own(i)}\n\nend {i}" for i in [*range(20), 21]}
    assert {i: r.text for i, r in out.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert 20 in {r.doc_id for r in q.keep_clean(docs, line_docs=5, lost_share=0.6).collect()}
    assert q.keep_clean(docs, line_docs=5).schema.simpleString() == docs.schema.simpleString()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert q.quality(docs).collect() == [] and q.keep_good(docs).collect() == []


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, where):
    verdict, n = compare(spark, connect(where), where, QUERIES["op2_quality"], ORACLES["op2_quality"])
    assert verdict.startswith("ok") and n > 0, verdict
