"""Secrets: fixed patterns, and a battery of randomness tests on code-like tokens.

Only built-in functions run here. Positions are code points: ``split`` and ``regexp_extract_all``
with one pattern give the stretches between the matches and the matches themselves, and adding up
their lengths places each match.

The battery asks of each token with letters and digits whether it could be ordinary text. Its
encoding is inferred (hexadecimal, base 32, 36, 62, 64), which gives the alphabet. Under the null
hypothesis of text
- the chi-squared distance from a uniform alphabet grows with the token's length,
- symbols of one class (digit, lower case, upper case, other) come in long runs,
- neighbouring symbols are correlated.
Each test becomes a normal score, large if the token is more random than text; the scores are
summed to one p-value. Over all tokens of the corpus, p-values are weighted by what the tests can
see at the token's length, and a step-up procedure holds the share of false discoveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.base import ROW, or_empty, query, stored, table

# The base patterns, in the order of the kinds.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of 16 characters or more; shorter runs hold no longer one
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

#: Tokens of the battery: maximal runs of code characters. No alphabet holds both characters of MIXED; a run
#: that does (a path in a URL) is cut at / and + into PARTS.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
MIXED = r"[+/][^_-]*[_-]|[_-][^+/]*[+/]"
PART = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by name: the pattern of its tokens and its alphabet in code order; the first fit counts.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    "hex upper": ("^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    "base32": ("^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    "base36": ("^[0-9a-z]+$", _DIGITS + _LOWER),
    "base36 upper": ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    "base62": ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    "base64": ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64 url": ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
}
#: Chance that two symbols of text are equal (letters of European languages, decimal digits).
TEXT_REPEAT = 0.065
#: Chance that text with numbers in it changes the class from one symbol to the next.
TEXT_CHANGE = 0.15
#: Correlation of neighbouring symbols in text with numbers in it.
TEXT_CORRELATION = 0.4
#: Share of false discoveries.
FALSE_SHARE = 0.01
#: Weights by length: least length and weight before they are scaled to a mean of 1.
LENGTH_WEIGHTS = [(16, 0.5), (24, 1.0), (32, 2.0), (48, 3.0), (96, 4.0)]
#: P-values are ranked in steps of a tenth of a power of ten, rounded up, down to 10^-40.
STEPS = 400


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, pair):
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["value"])
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"), pair["value"].alias("value"))).alias("out"))

    # Most texts have no match: one look decides.
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """(start, kind, end) of the base kinds, in order."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_VALUE)
    return F.array_sort(F.concat(as_spans(assign, 0), as_spans(matches(text, ACCESS), 1), as_spans(matches(text, HEX), 2)))


def parts(run: Column) -> Column:
    """The parts of a run that mixes alphabets, placed in the text; another run is its own part."""

    def place(m):
        return F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["value"].alias("value"))

    return F.when(run["value"].rlike(MIXED), F.transform(matches(run["value"], PART), place)).otherwise(F.array(run))


def code_tokens(text: Column) -> Column:
    """Tokens of 16 characters or more with letters and digits."""
    whole = F.flatten(F.transform(matches(text, TOKEN), parts))
    return F.filter(whole, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))


def upper_tail(z: Column) -> Column:
    """P(N > z), by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """``token`` rows with ``encoding``, the three scores and ``p``; tokens of no encoding go
    (``code_tokens`` gives none: a token holds characters of one alphabet only)."""
    alphabet = encoding = F.lit(None).cast("string")
    for name, (pattern, letters) in reversed(ENCODINGS.items()):
        fits = F.col("token").rlike(pattern)
        alphabet, encoding = F.when(fits, letters).otherwise(alphabet), F.when(fits, name).otherwise(encoding)
    n, a = F.col("n"), F.col("a")
    pairs = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    spread = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    shared = F.aggregate("next", F.lit(0.0), lambda s, p: s + (p["u"] - F.col("mean")) * (p["v"] - F.col("mean")))
    changes = F.size(F.regexp_extract_all(F.col("token"), F.lit("[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"), F.lit(0))) - 1
    squares = F.aggregate(F.array_distinct("x"), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter("x", lambda w: w == v)), F.lit(2.0)))
    atanh = lambda r: 0.5 * F.log((1 + r) / (1 - r))
    far = n * (F.greatest(a * TEXT_REPEAT, F.lit(1.5)) - 1)
    return (
        tokens.withColumn("alphabet", alphabet)
        .withColumn("encoding", encoding)
        .filter(F.col("alphabet").isNotNull())
        .withColumn("n", F.length("token").cast("double"))
        .withColumn("a", F.length("alphabet").cast("double"))
        .withColumn("x", F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
        .withColumn("mean", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n)
        .withColumn("next", pairs)
        .withColumn("chi2", a / n * squares - n)
        .withColumn("z_uniform", (a - 1 + far - F.col("chi2")) / F.sqrt(2 * (a - 1) + 4 * far))
        .withColumn("z_runs", (changes - TEXT_CHANGE * (n - 1)) / F.sqrt(TEXT_CHANGE * (1 - TEXT_CHANGE) * (n - 1)))
        .withColumn("r", F.least(F.lit(0.999), F.abs(F.coalesce(F.try_divide(shared, spread), F.lit(0.999)))))
        .withColumn("z_serial", (atanh(F.lit(TEXT_CORRELATION)) - atanh(F.col("r"))) * F.sqrt(n - 3))
        .withColumn("p", upper_tail((F.col("z_uniform") + F.col("z_runs") + F.col("z_serial")) / 3**0.5))
        .drop("x", "next", "mean", "alphabet", "a", "r")
    )


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(LENGTH_WEIGHTS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def p_step(p: Column) -> Column:
    """The p-value rounded up to a step of 10^-0.1."""
    return F.pow(F.lit(10.0), -F.least(F.lit(STEPS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300))))) / 10.0)


def weighted(tested: DataFrame) -> DataFrame:
    """``q``: the p-value over the weight of its length class. Weights have a mean of 1 over
    all tokens, so that the step-up procedure keeps its level."""
    classes = tested.groupBy(length_class(F.col("n")).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    raw = F.element_at(F.array(*(F.lit(w) for _, w in LENGTH_WEIGHTS)), F.col("class") + 1)
    one = Window.partitionBy(F.lit(0))  # a row per length class
    scaled = classes.select("class", (raw * F.sum("n_class").over(one) / F.sum(raw * F.col("n_class")).over(one)).alias("weight"))
    return tested.withColumn("class", length_class(F.col("n"))).join(F.broadcast(scaled), "class").withColumn("q", p_step(F.col("p")) / F.col("weight"))


def discovery_limit(tested: DataFrame, share: float) -> float:
    """The largest weighted p-value that the step-up procedure accepts; -1 if none is.

    Weighted values take at most ``STEPS`` times the number of length classes distinct
    values, so the ranking window sees a table of bounded size.
    """
    steps = tested.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("q"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    ranked = steps.select("q", (F.col("q") <= share * up_to / total).alias("passes"))
    limit = ranked.filter("passes").agg(F.max("q").alias("q")).first()["q"]
    return -1.0 if limit is None else limit


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """``doc_id`` and ``found``, an array of (start, kind, end) in order of start, then kind.

    Kinds index ``KINDS``. Spans of the base patterns always stay; a random token is added
    where it meets none of them. A NULL text is empty; an empty text has no spans. Repeated
    rows get the same spans each. An empty table gives an empty result.
    """
    text = or_empty("text")
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", base_spans(text).alias("base"), code_tokens(text).alias("tokens"))
    rows = stored(rows, "secrets")
    tokens = rows.select(ROW, F.explode("tokens").alias("t")).select(ROW, F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.value").alias("token"))
    tested = stored(battery(tokens).select(ROW, "start", "end", "n", "p"), "secret-tests")
    scored = weighted(tested)
    random = (
        scored.filter(F.col("q") <= discovery_limit(scored, share))
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("random"))  # tokens of one document
    )
    apart = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    added = F.coalesce(apart, F.array().cast("array<struct<start: int, kind: int, end: int>>"))
    return rows.join(random, ROW, "left").select("doc_id", F.array_sort(F.concat("base", added)).alias("found"))


def spell(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(spell(base), 256).alias("base_sha256"),
        spell(F.col("found")).alias("spans"),
    )
