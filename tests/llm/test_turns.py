import hashlib
import itertools
import random
import re
import zlib

from shelfmark.llm import turns as t
from shelfmark.llm.base import QUERIES

SPACE = " \t\n\r\x0b\x0c"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edit sequences, tried out."""
    marks = faults(rows)
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    moves = []
    for (role, text), fault in zip(rows, marks):
        extra = fault == "truncated"
        own = [("D", 3, "", None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", extra, role[:1] or "?", (role, text)), ("R", 2 + extra, "u", ("user", text)), ("R", 2 + extra, "a", ("assistant", text))]
        moves.append(own)
    best = None
    fills = {"u": ("user", ""), "a": ("assistant", "")}
    for chosen in itertools.product(*moves):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(m[1] for m in chosen) + 2 * sum(map(len, fill))
            if best is not None and cost > best[0]:
                continue
            initials = "".join(fill[0]) + "".join(m[2] + "".join(f) for m, f in zip(chosen, fill[1:]))
            if not re.fullmatch(r"(s?(ua)+)?", initials):
                continue
            audit = "I" * len(fill[0]) + "".join(m[0] + "I" * len(f) for m, f in zip(chosen, fill[1:]))
            made = [fills[x] for x in fill[0]]
            for m, f in zip(chosen, fill[1:]):
                made += ([m[3]] if m[3] else []) + [fills[x] for x in f]
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, made
    return best


def plain(rows):
    """Another way to the cheapest edits, for longer conversations: best (cost, letters) from each place and state."""
    marks = faults(rows)
    best = {(len(rows), s): (c, "I" * (c // 2)) for s, c in enumerate((0, 4, 2, 0))}
    for i in range(len(rows) - 1, -1, -1):
        (role, _), fault = rows[i], marks[i]
        own = {}
        for s, need in enumerate("uuau"):
            options = [(3 + best[i + 1, s][0], "D" + best[i + 1, s][1])]
            if fault not in ("blank", "duplicate"):
                to, extra = (3 if need == "a" else 2), fault == "truncated"
                options.append((2 + extra + best[i + 1, to][0], "R" + best[i + 1, to][1]))
                if role[:1] == need or (s == 0 and role[:1] == "s"):
                    to = 1 if role[:1] == "s" else to
                    options.append((extra + best[i + 1, to][0], "K" + best[i + 1, to][1]))
            own[s] = min(options)
        for _ in range(3):
            for s, to in enumerate((2, 2, 3, 2)):
                own[s] = min(own[s], (2 + own[to][0], "I" + own[to][1]))
        for s in range(4):
            best[i, s] = own[s]
    return best[0, 0]


def digest(made):
    return hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["Yes.", "No", "Why? ", " ", "Go!\n", "end. of"])) for _ in range(n)]


def test_all_edit_sequences(spark):
    rng = random.Random(4)
    convs = {i: random_rows(rng, rng.choice([1, 2, 3, 3])) for i in range(40)}
    table = spark.createDataFrame([(i, k, *r) for i, rows in convs.items() for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in t.repair_report(table).collect()}
    steps = {}
    for r in t.repaired_turns(table).collect():
        steps.setdefault(r.conv_id, []).append(r)
    for i, rows in convs.items():
        cost, audit, made = cheapest(rows)
        r = got[i]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, digest(made)), rows
        marks = faults(rows)
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        own = sorted(steps.get(i, []), key=lambda r: r.step)
        assert "".join(r.edit for r in own) == audit and [(r.role, r.text) for r in own if r.edit != "D"] == made


def test_written_decisions(spark, monkeypatch):
    """Conversations that are not held give what held ones give, in blocks of any size."""
    rng = random.Random(8)
    rows = [(c, k // 2, *r) for c in (1, 2, 3) for k, r in enumerate(random_rows(rng, 400))]
    rows += [(2, 7, "user", "same.")] * 60 + [(None, None, "user", "x" * 30)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = sorted(t.repair_report(table).collect(), key=str)
    for r in held:
        own = sorted((x[1:] for x in rows if x[0] == r.conv_id), key=lambda x: (x[0] is not None, x))
        assert (r.cost, r.audit) == plain([x[1:] for x in own])
    edits = sorted(t.repaired_turns(table).collect(), key=str)
    for limits in ((100, 10**6, 7), (0, 10**6, 1), (10**6, 50, 1000), (100, 10**6, 400)):
        for name, value in zip(("HELD_ROWS", "HELD_CHARS", "BLOCK_ROWS"), limits):
            monkeypatch.setattr(t, name, value)
        assert sorted(t.repair_report(table).collect(), key=str) == held
        assert sorted(t.repaired_turns(table).collect(), key=str) == edits


def test_edges(spark):
    schema = "conv_id string, turn int, role string, text string, cost string, gone string, extra int"
    rows = [
        ("a", None, "user", "Hi.", "c", None, 1),  # NULL turns come first
        ("a", 5, "assistant", "Yo.", "c", None, 1),
        ("a", 9, "assistant", "Yo.", "c", None, 1),
        (None, 1, None, "x.", None, None, 1),
        (None, 2, "user", None, None, None, 1),
        ("b", 1, "user", "Long. " * 200_000, None, None, 1),
        ("b", 1, "user", "Long. " * 200_000, None, None, 1),
    ]
    got = {r.conv_id: r for r in t.repair_report(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 3
    a, none, b = got["a"], got[None], got["b"]
    assert (a.gaps, a.duplicate, a.illegal, a.cost, a.audit) == (3, 1, 1, 3, "KKD")
    assert (none.blank, none.cost, none.audit) == (1, 6, "DD")
    assert (b.gaps, b.duplicate, b.cost, b.audit) == (0, 1, 5, "KDI")
    assert t.repair_report(spark.createDataFrame([], schema)).collect() == []
    assert t.repaired_turns(spark.createDataFrame([], schema)).collect() == []


def test_query(spark, data):
    convs = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        own = convs.setdefault(r.conv_id, [])
        hit = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if hit == 4 else r.role, "" if hit == 1 else re.sub("[.!?]", "", r.text) if hit == 2 else r.text
        own += [(r.turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    got = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, data).collect()}
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        rows.sort()
        cost, audit = plain([x[1:] for x in rows])
        assert (got[c].cost, got[c].audit) == (cost, audit)
        assert got[c].gaps == (rows[-1][0] - rows[0][0] + 1 - len({x[0] for x in rows}) if rows else 0)
