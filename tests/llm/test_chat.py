import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm import chat
from shelfmark.llm.base import ORACLES, QUERIES
from tools.check_oracle import compare, connect

HOSTILE = st.text(alphabet=st.sampled_from(list("<|\\>n\nrim_start|end ä\U0001f600")), max_size=30)


@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=5))
def test_round_trip(turns):
    parts = [chat.format_turn(r, t) for r, t in turns]
    assert chat.read_turns("".join(p[0] for p in parts)) == turns
    assert [chat.unescape(p[0][p[1] : p[2]]) for p in parts] == [t for _, t in turns]


def brute_paths(rows):
    parent = {n: p for n, p in rows}
    inner = {p for p in parent.values() if p in parent}
    out = {}
    for leaf in parent:
        if leaf in inner:
            continue
        way, n = [], leaf
        while n in parent:
            way.append(n)
            n = parent[n]
        out[leaf] = way[::-1]
    return out


def test_paths_of_a_forest(spark):
    rows = [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, 4), (7, 99), (8, None), (20, 21), (21, 20)]
    rows += [(100 + i, 99 + i if i else None) for i in range(37)]
    got = {}
    for r in chat.paths(spark.createDataFrame(rows, "node_id long, parent_id long")).collect():
        got.setdefault(r.leaf, []).append((r.dist, r.node_id))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in got.items()} == brute_paths([r for r in rows if r[0] not in (20, 21)])


def test_branches_are_ranked(spark):
    rows = [(1, None, 5, "user", "q", 1.0), (2, 1, 5, "assistant", "bad", 0.0), (3, 1, 5, "assistant", "good", 3.0), (4, 3, 5, "user", None, None), (5, None, None, None, "x", 0.5)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, conv_id long, role string, text string, score double")
    out = {(r.conv_id, r.branch): r for r in chat.format_conversations(nodes).collect()}
    assert set(out) == {(5, 1), (5, 2), (None, 1)}
    assert chat.read_turns(out[5, 1].formatted) == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert chat.read_turns(out[5, 2].formatted) == [("user", "q"), ("assistant", "bad")]
    assert [out[5, 1].formatted[s.start : s.end] for s in out[5, 1].learnt] == ["good"]
    assert [r.branch for r in chat.format_conversations(nodes, keep=1).collect()] == [1, 1]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, leaf string"
    assert chat.format_conversations(chat.chains(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (1, None, "user", "first", "x"), (None, 3, "assistant", "a" * 200_000, "x")]
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.chains(spark.createDataFrame(rows, schema)))).collect()}
    assert out[1].n_turns == 3 and out[None].loss_chars == 200_000
    assert out[1].turns_sha256 == hashlib.sha256(b"user\nfirst\n\n\n\n\n").hexdigest()


@pytest.mark.parametrize("name", ["op9_chat"])
def test_same_rows_as_sql(spark, data, name):
    verdict, n = compare(spark, connect(data), data, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok") and n > 0, verdict
