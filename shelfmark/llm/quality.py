"""Quality rules: counts inside each document, and lines that many documents of a host share.

The cross-document rule hashes normalised lines and counts the different documents of each host
that hold a line. Lines above the limits are removed, except from the first document (lowest id)
that holds them, and documents that are depleted by it are rejected: ``quality`` gives the counts
and the verdict, ``keep_clean`` the texts. Copies of one text count as
one document, and the first holder keeps its lines, so content that was only copied survives
somewhere; telling copies apart is the task of near-duplicate removal.
"""

from __future__ import annotations

from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.base import ROW, WORD, numbered, or_empty, query, stored, table

#: A line is removed when it is in at least this many different documents of a host ...
LINE_DOCS = 10
#: ... and in more than this share of them.
LINE_SHARE = 0.005
#: A document is depleted with fewer words left than this; it is also the least length.
LEAST_WORDS = 10
#: Where the lines are removed, a document is depleted also when it loses more than this share of its words.
LOST_SHARE = 0.5
#: Most words, in percent, that may lie in repeated five-word windows.
REPEAT_PERCENT = 20
WINDOW = 5
SALTS = 32
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[str]) -> int:
    """Words that lie in a five-word window which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    twice = set()
    for at, w in enumerate(windows):
        first = seen.setdefault(w, at)
        if first != at:
            twice.add(first)
            twice.add(at)
    starts = sorted(twice)
    return WINDOW + sum(min(WINDOW, b - a) for a, b in pairwise(starts))


def line_key(inside: list[str]) -> int:
    """The hash of a normalised line, from its words."""
    return xxhash.xxh3_64_intdigest(" ".join(inside).lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def measure(text: str) -> tuple[list[int], dict[int, int]]:
    """The base counts, and a hash of each normalised line with the words it holds."""
    words = WORD.findall(text)
    lines: dict[int, int] = {}
    raw, duplicate = set(), 0
    for line in text.split("\n"):
        inside = WORD.findall(line)
        if not inside:
            continue
        if line in raw:
            duplicate += 1
        raw.add(line)
        key = line_key(inside)
        lines[key] = lines.get(key, 0) + len(inside)
    symbols = sum(map(text.count, SYMBOLS))
    return [len(words), sum(map(len, words)), symbols, duplicate, repeat_words(words)], lines


def measured(rows: DataFrame) -> DataFrame:
    """``_row, doc_id, host, text`` as ``_row``, ``doc_id``, ``host``, ``_doc`` (the text's
    hash), base counts and ``_lines``, an array of (key, words) with each line once."""
    passed = [ROW, "doc_id", "host", "_doc"]

    def run(batches):
        for batch in batches:
            counts, lines = [], []
            for text in batch.column("text").to_pylist():
                c, held = measure(text or "")
                counts.append(c)
                lines.append([{"key": k, "words": n} for k, n in held.items()])
            base = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), *base, pa.array(lines, line_type)], names=[*passed, *BASE, "_lines"])

    line_type = pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int64())]))
    counts = ", ".join(f"{c} bigint" for c in BASE)
    given = rows.select(ROW, "doc_id", "host", F.xxhash64("text").alias("_doc"), "text")
    shape = f"{ROW} bigint, doc_id {dict(given.dtypes)['doc_id']}, host string, _doc bigint, {counts}, _lines array<struct<key: bigint, words: bigint>>"
    return given.mapInArrow(run, shape)


def frequent_lines(docs: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """``host``, ``key``, ``_first`` (the first holder's text hash) of lines above both limits."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_doc"))
    texts = docs.groupBy("host", "_doc").agg(F.min(order).alias("_at"), F.first("_lines").alias("_lines"))
    totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("_total"))
    counts = (
        texts.select("host", "_doc", "_at", F.explode("_lines.key").alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min_by("_doc", "_at").alias("_first"))
        .filter(F.col("n_docs") >= line_docs)
    )
    return counts.join(totals, "host").filter(F.col("n_docs") > line_share * F.col("_total")).select("host", "key", "_first")


def judge(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Verdicts for ``_row, doc_id, host, text``: ``_row``, ``doc_id``, the base counts,
    ``n_removed_words``, ``removed`` (keys of the removed lines), ``base_failed``, ``kept``."""
    docs = stored(measured(rows), "quality")
    frequent = frequent_lines(docs, line_docs, line_share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = (
        docs.select(ROW, "host", "_doc", F.explode("_lines").alias("_line"))
        .select(ROW, "host", "_doc", F.col("_line.key").alias("key"), F.col("_line.words").alias("words"), F.pmod(ROW, F.lit(SALTS)).cast("int").alias("_salt"))
        .join(frequent, ["host", "key", "_salt"])
        .filter(F.col("_doc") != F.col("_first"))
        .groupBy(ROW)
        .agg(F.sum("words").alias("n_removed_words"), F.collect_set("key").alias("removed"))  # lines of one document
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        docs.drop("_lines", "host", "_doc")
        .join(lost, ROW, "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("bigint"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= LEAST_WORDS))
    )


def as_rows(docs: DataFrame, host: str) -> DataFrame:
    """What ``judge`` reads, of rows that have a ``_row``; a NULL host is a host of its own."""
    return docs.select(ROW, "doc_id", F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"), "text")


def quality(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """``doc_id``, the base counts, ``n_removed_words``, ``removed``, ``base_failed`` and
    ``kept`` for every row.

    A NULL text has no words and fails; so does an empty one. Repeated rows get the same
    verdict each. The first holder of a line is the document with the lowest id, NULL last;
    between rows of one id the lower text hash. An empty table gives an empty result.
    """
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())  # fixed by the write in judge
    return judge(as_rows(rows, host), line_docs, line_share).drop(ROW)


def keep_good(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts as they were; edge cases as in ``quality``."""
    rows = numbered(docs, "quality-rows")
    good = judge(as_rows(rows, host), line_docs, line_share).filter("kept").select(ROW)
    return rows.join(good, ROW, "left_semi").select(docs.columns)


def without_lines(text: str, removed: set[int]) -> str:
    """The text without the lines of these keys; lines without a word stay."""
    return "\n".join(line for line in text.split("\n") if not (inside := WORD.findall(line)) or line_key(inside) not in removed)


def keep_clean(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, lost_share: float = LOST_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the lines above the limits.

    The first holder of a line keeps it. Rejected is what ``quality`` rejects, and a document that
    loses more than ``lost_share`` of its words. Lines go with their line break; a text that loses
    none stays as it was. ``n_chars``, where ``docs`` has it, is the length of a changed text.
    Edge cases as in ``quality``.
    """
    rows = numbered(docs, "quality-rows")
    depleted = F.col("n_removed_words") > lost_share * F.col("n_words")
    good = judge(as_rows(rows, host), line_docs, line_share).filter(F.col("kept") & ~depleted).select(ROW, F.col("removed").alias("_removed"))
    joined = rows.join(good, ROW)
    # Only texts that lose a line pass through Python's lines.
    changed = joined.select("*", F.when(F.col("_removed").isNotNull(), or_empty("text")).alias("_old"))

    def run(batches):
        for batch in batches:
            old, removed = batch.column("_old").to_pylist(), batch.column("_removed").to_pylist()
            new = pa.array([None if t is None else without_lines(t, set(r)) for t, r in zip(old, removed)], pa.string())
            kept = [c for c in batch.schema.names if c not in ("_old", "_removed")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), new], names=[*kept, "_new"])

    kept = changed.drop("_old", "_removed").schema
    out = changed.mapInArrow(run, kept.add("_new", "string"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("_new").isNotNull(), F.length("_new").cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce("_new", "text")).select(docs.columns)


_WORD = WORD.pattern
_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(regexp_extract_all(text, '{_WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS pos FROM docs),
counts AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY 1),
windows AS (
  SELECT r, pos, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS five, lead(w, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, five) AS n FROM windows WHERE w5 IS NOT NULL) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(pos, pos + {WINDOW})) AS p FROM twice) GROUP BY 1),
lines AS (
  SELECT r, doc_id, source, text, line, list_aggregate(regexp_extract_all(line, '{_WORD}'), 'count') AS n,
    lower(array_to_string(regexp_extract_all(line, '{_WORD}'), ' ')) AS plain
  FROM (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')),
duplicates AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1),
totals AS (SELECT source, count(DISTINCT text) AS total FROM docs GROUP BY 1),
frequent AS (
  SELECT source, plain, first_text FROM (
    SELECT source, plain, count(DISTINCT text) AS n_docs, arg_min(text, doc_id) AS first_text FROM lines GROUP BY 1, 2) JOIN totals USING (source)
  WHERE n_docs >= {LINE_DOCS} AND n_docs > {LINE_SHARE} * total),
lost AS (
  SELECT r, sum(n) AS n_removed_words FROM lines JOIN frequent ON lines.source = frequent.source AND lines.plain = frequent.plain
  WHERE text <> first_text GROUP BY 1),
judged AS (
  SELECT docs.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM docs LEFT JOIN counts USING (r) LEFT JOIN repeated USING (r) LEFT JOIN duplicates USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND n_words - n_removed_words >= {LEAST_WORDS} AS kept
FROM judged"""


@query("op2_quality", _SQL)
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    return quality(table(spark, sf_dir, "documents")).drop("removed")
