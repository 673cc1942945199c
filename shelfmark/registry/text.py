"""Text search queries: benchmark passages against documents, names against products."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import stemming
from shelfmark.functions import text as X
from shelfmark.operators import textsearch as ops
from shelfmark.operators import textstore as store
from shelfmark.registry.base import (
    BENCHMARK,
    DOCUMENTS,
    PRODUCTS,
    STOP_LIST,
    benchmark,
    documents,
    products,
    query,
    ranked_sql,
    search_sql,
    stem_sql,
    table,
    tokens_sql,
)
from shelfmark.session import scratch_path, staged

SEARCH = f"WITH {search_sql(DOCUMENTS, BENCHMARK)}"


@query(
    "text_index",
    f"""WITH {tokens_sql('t', DOCUMENTS, 'pid', 'document')} SELECT term, pid, count(*) AS tf,
    string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM t GROUP BY 1, 2""",
)
def text_index(spark, sf_dir):
    index = ops.text_index(documents(spark, sf_dir))
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(
    "stem_s",
    f"""SELECT DISTINCT w AS word, {stem_sql('w')} AS stem FROM (
      SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)""",
)
def stem_s(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    return found.withColumn("stem", X.stem(F.col("word")))


SYLLABLE = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _stem_step(name: str, source: str, endings, rule: str) -> str:
    """A CTE that takes the longest of the endings as ``e`` off as ``b``, and makes ``w`` by the rule."""
    return f"""{name} AS (SELECT word, done, r1, r2, {rule} AS w FROM (
      SELECT *, left(w, len(w) - len(e)) AS b FROM (SELECT *, regexp_extract(w, '({"|".join(sorted(endings, key=len, reverse=True))})$') AS e FROM {source})))"""


def english_sql(source: str) -> str:
    """CTEs from ``source(word)`` to ``stems(word, stem)``: the English stemmer by regular expressions."""

    def replaced(step: dict[str, str]) -> str:
        return "CASE e " + " ".join(f"WHEN '{e}' THEN b || '{to}'" for e, to in step.items()) + " END"

    region = "coalesce(nullif(len(regexp_extract({0}, '" + SYLLABLE + "')), 0), len({0}))"
    known = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stemming.EXCEPTIONS.items())
    starts = " ".join(f"WHEN w LIKE '{h}%' THEN {len(h)}" for h in stemming.REGION_STARTS)
    later = ", ".join(f"'{w}'" for w in sorted(stemming.UNCHANGED_LATER))
    short_end = "(regexp_matches({0}, '^[aeiouy][^aeiouy]$') OR regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"
    past = f"""CASE WHEN e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN len(b) >= r1 THEN b || 'ee' ELSE w END
      WHEN NOT regexp_matches(b, '[aeiouy]') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
      WHEN regexp_matches(b, '({"|".join(stemming.DOUBLES)})$') THEN left(b, len(b) - 1)
      WHEN r1 >= len(b) AND {short_end.format('b')} THEN b || 'e' ELSE b END"""
    li = "".join(sorted(stemming.LI_ENDINGS))
    two = f"CASE WHEN e = '' OR len(b) < r1 OR (e = 'ogi' AND b NOT LIKE '%l') OR (e = 'li' AND NOT regexp_matches(b, '[{li}]$')) THEN w ELSE {replaced(stemming.STEP_2)} END"
    three = f"CASE WHEN e = '' OR len(b) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN w ELSE {replaced(stemming.STEP_3)} END"
    four = "CASE WHEN e = '' OR len(b) < r2 OR (e = 'ion' AND NOT regexp_matches(b, '[st]$')) THEN w ELSE b END"
    last = f"""CASE WHEN e = 'e' AND (len(b) >= r2 OR (len(b) >= r1 AND NOT {short_end.format('b')})) THEN b
      WHEN e = 'l' AND b LIKE '%l' AND len(b) >= r2 THEN b ELSE w END"""
    return f"""s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w,
      CASE word {known} ELSE CASE WHEN len(word) <= 2 THEN word END END AS done FROM {source}),
    s1 AS (SELECT *, r1 + {region.format('substr(w, r1 + 1)')} AS r2 FROM (SELECT *, CASE {starts} ELSE {region.format('w')} END AS r1 FROM s0)),
    s2 AS (SELECT word, r1, r2, w, coalesce(done, CASE WHEN w IN ({later}) THEN w END) AS done FROM (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN left(w, len(w) - 2)
      WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, len(w) - CASE WHEN len(w) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(w, '(us|ss)$') THEN w
      WHEN w LIKE '%s' AND regexp_matches(left(w, len(w) - 2), '[aeiouy]') THEN left(w, len(w) - 1) ELSE w END AS w) FROM s1)),
    {_stem_step('s3', 's2', ('eedly', 'eed', 'edly', 'ed', 'ingly', 'ing'), past)},
    s4 AS (SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w) FROM s3),
    {_stem_step('s5', 's4', stemming.STEP_2, two)}, {_stem_step('s6', 's5', stemming.STEP_3, three)}, {_stem_step('s7', 's6', stemming.STEP_4, four)},
    {_stem_step('s8', 's7', ('e', 'l'), last)},
    stems AS (SELECT word, coalesce(done, replace(w, 'Y', 'y')) AS stem FROM s8)"""


VOCABULARY = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)"


@query("stem_english", f"WITH {english_sql(VOCABULARY)} SELECT word, stem FROM stems")
def stem_english(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    return ops.english_stems(found)


@query(
    "text_index_english",
    f"""WITH {english_sql(VOCABULARY)},
    t AS (SELECT pid, position, w FROM (SELECT doc_id AS pid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w,
      generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS position FROM documents) WHERE w NOT IN ({STOP_LIST}))
    SELECT stem AS term, pid, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM t JOIN stems ON word = w GROUP BY 1, 2""",
)
def text_index_english(spark, sf_dir):
    index = ops.text_index(documents(spark, sf_dir), stemming="english")
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def searched(spark, sf_dir):
    """The postings that the passages ask for, made in one scan of all documents, and the parsed passages."""
    parsed = ops.parse_queries(benchmark(spark, sf_dir))
    return staged(ops.query_postings(documents(spark, sf_dir), parsed), "postings"), parsed


@query("match_all_terms", f"{SEARCH} SELECT query_id, pid, CAST(n AS INTEGER) AS n_terms FROM pairs")
def match_all_terms(spark, sf_dir):
    return ops.match_all_terms(*searched(spark, sf_dir))


FREQUENCY = """SELECT query_id, pid, round(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) / any_value(n), 6) AS score
    FROM matched GROUP BY 1, 2"""


@query("rank_frequency", f"{SEARCH} {FREQUENCY}")
def rank_frequency(spark, sf_dir):
    return ops.rank_frequency(*searched(spark, sf_dir)).withColumn("score", F.round("score", 6))


# Covers in SQL: for every matched position, the last place of each term up to it; the
# leftmost of them opens the tightest cover ending there, and the first end per opening
# is a minimal cover.
COVERS = """places AS (SELECT query_id, pid, n, d.term, position,
        row_number() OVER (PARTITION BY query_id, pid ORDER BY position) AS i
      FROM pairs JOIN terms t USING (query_id) JOIN doc_tokens d USING (pid, term)),
    lasts AS (SELECT a.query_id, a.pid, a.i, a.position, t.term,
        max(CASE WHEN a.term = t.term THEN a.i END) OVER (PARTITION BY a.query_id, a.pid, t.term ORDER BY a.i) AS seen
      FROM places a JOIN terms t ON t.query_id = a.query_id),
    ends AS (SELECT query_id, pid, i, position, min(coalesce(seen, 0)) AS opening FROM lasts GROUP BY 1, 2, 3, 4),
    covers AS (SELECT query_id, pid, opening, min(i) AS i, min(position) AS position FROM ends WHERE opening > 0 GROUP BY 1, 2, 3)"""


@query(
    "rank_cover_density",
    f"""{SEARCH}, {COVERS} SELECT c.query_id, c.pid,
      round(sum(1.0::DOUBLE / (1 + (c.position - o.position) - (c.i - c.opening))), 6) AS score
    FROM covers c JOIN places o ON o.query_id = c.query_id AND o.pid = c.pid AND o.i = c.opening GROUP BY 1, 2""",
)
def rank_cover_density(spark, sf_dir):
    return ops.rank_cover_density(*searched(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "rank_tfidf",
    f"""{SEARCH} SELECT query_id, pid, round(sum(tf * ln((n_docs + 1.0::DOUBLE) / (df + 1.0::DOUBLE))), 6) AS score
    FROM matched JOIN stats USING (term), (SELECT count(*) AS n_docs FROM documents) GROUP BY 1, 2""",
)
def rank_tfidf(spark, sf_dir):
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    return ops.rank_tfidf(*searched(spark, sf_dir), n_docs).withColumn("score", F.round("score", 6))


NAMES = "(SELECT DISTINCT p_name AS query_id, p_name AS text FROM part)"
NAME_SEARCH = f"WITH products AS ({PRODUCTS}), {search_sql('products', NAMES)}, freq AS ({FREQUENCY})"


def name_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()


@query(
    "text_topk",
    f"""{NAME_SEARCH} SELECT query_id, pid, CAST(rank AS INTEGER) AS rank, round(CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 0
      ELSE score / max(score) OVER (PARTITION BY query_id) END, 6) AS score FROM ({ranked_sql('freq', 10)})""",
)
def text_topk(spark, sf_dir):
    parsed = ops.parse_queries(name_texts(spark, sf_dir))
    scored = ops.rank_frequency(staged(ops.query_postings(products(spark, sf_dir), parsed), "postings"), parsed)
    return ops.text_topk(scored, 10).withColumn("score", F.round("score", 6))


# --- a stored index -------------------------------------------------------------------

COVER_SCORES = f"""{COVERS}, scores AS (SELECT c.query_id, c.pid, sum(1.0::DOUBLE / (1 + (c.position - o.position) - (c.i - c.opening))) AS score
    FROM covers c JOIN places o ON o.query_id = c.query_id AND o.pid = c.pid AND o.i = c.opening GROUP BY 1, 2)"""
TOP = "SELECT query_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"
#: Benchmark passages, and the words that begin documents: short queries with many matches.
ASKED = """(SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark
    UNION ALL SELECT DISTINCT concat('w ', w), w FROM (SELECT substring(text, 1, 5) AS w FROM documents))"""


def asked(spark, sf_dir):
    passages = benchmark(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), "text")
    starts = documents(spark, sf_dir).select(F.substring("document", 1, 5).alias("text")).distinct()
    return passages.unionByName(starts.select(F.concat(F.lit("w "), F.col("text")).alias("query_id"), "text"))


STORE_SEARCH = f"WITH {search_sql(DOCUMENTS, ASKED)}"


def stored(spark, sf_dir):
    return store.store_of(documents(spark, sf_dir), buckets=16, block_rows=32)


@query("text_store_search", f"{STORE_SEARCH}, freq AS ({FREQUENCY}) {TOP} FROM ({ranked_sql('freq', 10)})")
def text_store_search(spark, sf_dir):
    found = store.search(stored(spark, sf_dir), asked(spark, sf_dir), 10, store.RANKERS["ts_rank"])
    return found.withColumn("score", F.round("score", 6))


@query("text_store_cover", f"{STORE_SEARCH}, {COVER_SCORES} {TOP} FROM ({ranked_sql('scores', 10)})")
def text_store_cover(spark, sf_dir):
    found = store.search(stored(spark, sf_dir), asked(spark, sf_dir), 10, store.RANKERS["ts_rank_cd"])
    return found.withColumn("score", F.round("score", 6))


@query("text_store_append", f"{STORE_SEARCH}, freq AS ({FREQUENCY}) {TOP} FROM ({ranked_sql('freq', 10)})")
def text_store_append(spark, sf_dir):
    """A store of the shorter documents, the others added by two overlapping appends."""
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "text-appended")
    short, even = F.coalesce(F.length("document"), F.lit(0)) < 1500, F.col("pid") % 2 == 0
    store.write_store(docs.filter(short), path, buckets=16, block_rows=32)
    store.append_store(docs.filter(short | even), path)
    store.append_store(docs, path)
    found = store.search(store.read_store(spark, path), asked(spark, sf_dir), 10, store.RANKERS["ts_rank"])
    return found.withColumn("score", F.round("score", 6))


@query(
    "text_store_terms",
    f"""WITH {tokens_sql('t', DOCUMENTS, 'pid', 'document')}, p AS (SELECT term, pid, count(*) AS tf FROM t GROUP BY 1, 2)
    SELECT term, CAST(count(*) AS BIGINT) AS df, max(tf) AS max_tf FROM p GROUP BY 1""",
)
def text_store_terms(spark, sf_dir):
    """What the block rows say of each term."""
    return stored(spark, sf_dir).blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"))
