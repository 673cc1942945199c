import base64
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from shelfmark.llm import secrets as s
from shelfmark.llm.base import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SCHEMA = "doc_id long, text string, found string"


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


HAND = [
    "", None, "nothing here", "\U0001f600é PassWord = 'abcdefgh' x", "token=short token: secret: abcdefghij", "api_key:apikey=12345678", "secret==ab=cdefgh",
    "AKIAABCDEFGHIJKL AKIAAKIAABCDEF AKIA1", "0" * 31 + " " + "f" * 32 + "g" + "0a" * 40, "passwd\"  :  'é", "token = " + "a" * 300_000, "x AKIA" + "Z9" * 50,
    "ſecret=abcdefgh", "İ token=abcdefghi\ntoken=\nabcdefghi", "password=password=password=",
]


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["token", "api_key", "Secret", "=", ": ", '"', "'", " ", "abc", "0123456789abcdef", "AKIA", "ABCD1234", "é", "\n", ".", "-"]
    texts = HAND + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    for r in s.find_secrets(docs).select("doc_id", s.spell(F.filter("found", lambda x: x["kind"] < 3)).alias("base")).collect():
        assert r.base == brute_base(texts[r.doc_id] or ""), texts[r.doc_id]


def brute_scores(token):
    alphabet = next(a for p, a in s.ENCODINGS.values() if re.match(p, token))
    n, a = len(token), len(alphabet)
    x = [alphabet.index(c) for c in token]
    chi2 = sum((x.count(v) - n / a) ** 2 / (n / a) for v in range(a))
    far = n * (max(a * s.TEXT_REPEAT, 1.5) - 1)
    kind = [c.isdigit() + 2 * c.islower() + 3 * c.isupper() for c in token]
    changes = sum(u != v for u, v in zip(kind, kind[1:]))
    mean = sum(x) / n
    r = abs(sum((u - mean) * (v - mean) for u, v in zip(x, x[1:])) / sum((u - mean) ** 2 for u in x))
    z = (a - 1 + far - chi2) / math.sqrt(2 * (a - 1) + 4 * far)
    z += (changes - 0.15 * (n - 1)) / math.sqrt(0.15 * 0.85 * (n - 1))
    z += (math.atanh(0.4) - math.atanh(min(r, 0.999))) * math.sqrt(n - 3)
    return 0.5 * math.erfc(z / math.sqrt(3) / math.sqrt(2))


def test_battery(spark):
    rng = random.Random(5)
    tokens = [rng.randbytes(k).hex() for k in range(8, 40)] + [base64.b64encode(rng.randbytes(k)).decode().strip("=") for k in range(12, 60)]
    tokens += [f"version{i}ofthedocument{i}" for i in range(100, 140)] + ["0000000000000000a", "aaaaaaaaaaaaaaaaaaaa1"]
    out = {r.token: r.p for r in s.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for t in tokens:
        assert abs(out[t] - brute_scores(t)) < 1e-6, t


def test_random_tokens_are_found_and_text_is_not(spark):
    rng = random.Random(6)
    secret = [base64.urlsafe_b64encode(rng.randbytes(24)).decode() for _ in range(40)]
    plain = [f"chapter{i}section{i % 7}introduction" for i in range(400)]
    rows = [(i, f"see {t} there", "x") for i, t in enumerate(secret)] + [(1000 + i, f"see {t} there", "x") for i, t in enumerate(plain)]
    out = {r.doc_id: r.spans for r in s.find_secrets(spark.createDataFrame(rows, SCHEMA)).select("doc_id", s.spell(F.col("found")).alias("spans")).collect()}
    hit = [i for i, spans in out.items() if spans]
    assert sum(i < 1000 for i in hit) >= 38
    assert sum(i >= 1000 for i in hit) <= 1
    assert all(out[i] == f"random:4:{4 + len(secret[i])}" for i in hit if i < 1000)


def test_tokens_in_paths(spark):
    rng = random.Random(7)
    before = ["https://a.example/reset-password/", "/api_v1/", "x/", "see é+a-b+"]
    rows, wanted = [], {}
    for i in range(60):
        key = base64.urlsafe_b64encode(rng.randbytes(30)).decode()
        key = key if set("-_") & set(key) else key[:-1] + "_"
        head = before[i % 4]
        rows.append((i, f"{head}{key}{'/send-now' if i % 3 else ''} end", "x"))
        wanted[i] = f"random:{len(head)}:{len(head) + len(key)}"
    rows += [(1000 + i, f"/my-docs/chapter{i}section{i % 7}introduction/part_{i}", "x") for i in range(300)]
    out = {r.doc_id: r.spans for r in s.find_secrets(spark.createDataFrame(rows, SCHEMA)).select("doc_id", s.spell(F.col("found")).alias("spans")).collect()}
    assert sum(out[i] == wanted[i] for i in range(60)) >= 57
    assert all(out[i] in ("", wanted[i]) for i in range(60))
    assert sum(bool(out[1000 + i]) for i in range(300)) <= 1
    # A run of one alphabet stays whole.
    assert spark.createDataFrame([("ab/cd+0123456789abcd ef_gh-0123456789",)], "t string").select(s.code_tokens(F.col("t")).alias("x")).first()["x"] == [(0, 20, "ab/cd+0123456789abcd"), (21, 37, "ef_gh-0123456789")]


def test_empty_table(spark):
    assert s.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    where = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    out = QUERIES["op3_secrets"](spark, where).collect()
    assert len(out) == len(texts)
    for r in out:
        base = brute_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k + ":") for x in base.split(",")) for k in s.KINDS[:3]]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert sum("random" in r.spans for r in out) <= 20
