import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import packing as p
from shelfmark.llm.base import QUERIES

SCHEMA = "doc_id long, text string, length string, sequence_id long"


def check_plan(histogram, capacity):
    configurations = p.plan(histogram, capacity)
    held = Counter()
    for config, times in configurations:
        assert times > 0 and sum(n * c for n, c in config.items()) <= capacity
        for n, c in config.items():
            held[n] += c * times
    assert held == Counter({n: c for n, c in histogram.items() if c})
    return sum(times for _, times in configurations)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=12))
def test_plan_holds_every_piece_once(histogram):
    check_plan(histogram, 20)


def best_fit(histogram, capacity):
    room = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(3))
def test_close_to_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(2048, 1 + rng.exponential(400, 3000).astype(int))
    histogram = Counter(sizes.tolist())
    n = check_plan(histogram, 2048)
    assert n <= best_fit(histogram, 2048) and n <= math.ceil(sizes.sum() / 2048) + 2


def test_large_counts():
    # Prices 0.5, 0.4 and 0.2 are dual feasible, so 2.6 thousand million is a lower bound.
    assert check_plan({1000: 3_000_000_000, 700: 2_000_000_000, 400: 1_500_000_000, 348: 7}, 2048) <= 2_600_000_003


def test_dearest_is_optimal():
    lengths, prices = np.array([3, 5, 7]), np.array([0.29, 0.52, 0.7])
    best = max(a * 0.29 + b * 0.52 + c * 0.7 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 19)
    assert abs(p.dearest(lengths, prices, 19) @ prices - best) < 1e-12


def check_rows(rows, docs, capacity=2048):
    tokenizer = Tokenizer.from_file(p.tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for ident, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[ident, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


ODD = [
    None, "", " \n ", "A b\x1cc\x85d\xa0e f　g", "é ́x É", "don't I'LL 've x's", "<|endoftext|> <|startoftext|>x", "1234 ½² İstanbul ΣΣ ẞ",
    "\U0001f600\U0001f600 中文 #$%a_b__c ﻿​", "same", "same", "long " * 30_000, "x" * 5000,
]


def test_ids_and_places(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "same"), (None, "same"), (3, "again")]
    rows = p.pack(spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)).collect()
    check_rows(rows, docs)


WORDISH = st.text(alphabet=st.sampled_from(list("abZéÉßÿÀ×÷ªµ'.,;|<>_-s1² \u0301\n")), max_size=30)


@given(st.lists(st.one_of(st.text(max_size=40), WORDISH), max_size=5))
@settings(deadline=None, max_examples=400)
def test_word_wise_ids_are_whole_text_ids(texts):
    encoder = p._ENCODERS.setdefault("test", p.Encoder(p.tokenizer_path()))
    assert encoder.encode(texts) == encoder.ids_of(texts)


def test_pieces_are_tokenized_once():
    encoder = p.Encoder(p.tokenizer_path())
    texts = [f"{a}{w}{b}" for a in ("", "(", "4") for w in ("alpha", "Alpha", "ALPHA", "état", "ÉTAT") for b in ("", ",", "...", ")-alpha")]
    assert encoder.encode(texts) == encoder.ids_of(texts)
    assert len(encoder.known) <= 8  # two words, the digit and five runs of marks


def test_few_known_pieces(monkeypatch):
    monkeypatch.setattr(p, "CACHED", 4)
    encoder = p.Encoder(p.tokenizer_path())
    for texts in (["one two three", "J\u030c É×a"], ["two, four's five six", "x" * 100], ["six two"], []):
        assert encoder.encode(texts) == encoder.ids_of(texts)
        assert b"x" * 100 not in encoder.known
    assert set(encoder.known) == {b"six", b"two"}


def test_sequences(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma " * i) for i in range(1, 30)], "doc_id long, text string")
    out = p.packed_sequences(docs, capacity=64).collect()
    assert all(len(r.ids) <= 64 for r in out) and sum(r.ids.count(0) for r in out) == 29


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    n, total = check_rows(QUERIES["op1_packing"](spark, data).collect(), docs)
    assert n <= math.ceil(total / 2048) + 1
