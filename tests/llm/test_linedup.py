from collections import defaultdict

from shelfmark.llm.base import ORACLES, QUERIES
from shelfmark.llm.linedup import drop_boilerplate
from tools.check_oracle import compare, connect

SCHEMA = "doc_id long, text string, source string, n_chars long, n_dropped string"


def brute(rows, ratio, min_pages):
    pages, held = defaultdict(set), defaultdict(set)
    plain = lambda x: " ".join(x.lower().replace("\x0b", " ").replace("\x0c", " ").split())
    for _, text, host in rows:
        pages[host].add(text)
        for line in (text or "").split("\n"):
            if plain(line):
                held[host, plain(line)].add(text)
    bad = {k for k, v in held.items() if len(v) >= min_pages and len(v) > ratio * len(pages[k[0]])}
    out = []
    for ident, text, host in rows:
        lines = [] if text is None else text.split("\n")
        keep = [x for x in lines if (host, plain(x)) not in bad]
        out.append((ident, None if text is None else "\n".join(keep), sum(bool(plain(x)) for x in lines), len(lines) - len(keep)))
    return out


def test_against_brute_force(spark):
    rows = []
    for i in range(60):
        host = ["a", "b", None][i % 3]
        text = f"Home  MENU\n\nstory {i} of {host}\n  shared {i % 7}\t\nend {i}"
        rows.append((i, text if i % 10 else "home menu", host))
    rows += [(100, None, "a"), (101, "", "a"), (102, "\n\n", None), (103, "HOME menu\nHOME menu", "b"), (None, "Home menu\nx", "b"), (None, "Home menu\nx", "b")]
    rows += [(200 + i, "only copies\nof one page", "a") for i in range(30)]
    rows.append((300, "long " * 50_000 + "\nhome menu", "a"))
    docs = spark.createDataFrame([(i, t, h, len(t or ""), "clash") for i, t, h in rows], SCHEMA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for ratio, least in ((0.3, 5), (0.1, 2)):
        out = drop_boilerplate(docs, ratio=ratio, min_pages=least).collect()
        assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out], key=key) == sorted(brute(rows, ratio, least), key=key)
        assert all(r.n_chars == len(r.text or "") for r in out)


def test_empty_table(spark):
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_same_rows_as_sql(spark, data):
    verdict, n = compare(spark, connect(data), data, QUERIES["op6_line_dedup"], ORACLES["op6_line_dedup"])
    assert verdict.startswith("ok") and n > 0, verdict
