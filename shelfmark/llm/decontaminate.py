"""Benchmark decontamination: BM25 over the test items with block-max bounds.

The test items are the indexed side and every training passage is a query. Item scores are divided
by a share of the item's score for itself, so one threshold, 1, holds for all items. Items lie in
blocks of similar ones; for each term a block keeps the largest weight that one of its items
gives it. As in block-max WAND, a passage whose block maxima add up to less than the threshold
skips the whole block, which is exact; what remains is scored item by item. All passages of a batch
are bounded at once by array operations. Retrieved pairs are then verified on five-word shingles
of question and answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.base import ROW, numbered, or_empty, query, table

TOKEN = re.compile(r"\w+")
#: An item ends with its answer: the last sentence, where there is no column for it.
LAST_SENTENCE = re.compile(r"(?s)^(.*[.!?])\s+(\S.*)$")
SHINGLE = 5
OVERLAP = 0.8

#: Parameters of BM25, and the share of an item's own score that a passage has to reach.
K1, B = 1.2, 0.75
SCORE_SHARE = 0.5
BLOCK, PART = 8, 512
#: Passages are two chunks long and start at each chunk; a chunk is as long as the longest item.
LEAST_CHUNK = 64
#: Characters of test items that one scan of the corpus handles; more go in further scans.
SCAN_CHARS = 16_000_000


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def shingles(words: list) -> set[tuple]:
    """Five-word shingles; a shorter text is one shingle, an empty one has none."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}


def question_and_answer(text: str) -> tuple[str, str]:
    found = LAST_SENTENCE.match(text)
    return (found[1], found[2]) if found else (text, "")


class Part:
    """Index of up to ``PART`` items."""

    def __init__(self, items: list[tuple[int, str]]):
        bags = [Counter(tokens(text)) for _, text in items]
        df = Counter(w for bag in bags for w in bag)
        # Similar items side by side make tight block maxima: order by their commonest terms.
        order = sorted(range(len(items)), key=lambda i: sorted(((-df[w], w) for w in bags[i]))[:6])
        self.items = [items[i] for i in order]
        bags = [bags[i] for i in order]
        sizes = [sum(bag.values()) for bag in bags]
        mean = sum(sizes) / max(1, len(sizes)) or 1.0
        self.terms = {w: i for i, w in enumerate(sorted(df))}
        self.weight = np.zeros((len(self.terms), -(-len(items) // BLOCK) * BLOCK), dtype=np.float32)
        for i, bag in enumerate(bags):
            for w, tf in bag.items():
                idf = math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
                self.weight[self.terms[w], i] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean))
        own = self.weight.sum(axis=0)
        self.weight /= np.where(own > 0, SCORE_SHARE * own, 1)
        self.block_max = self.weight.reshape(len(self.terms), -1, BLOCK).max(axis=2)
        self.chunk = max(LEAST_CHUNK, *sizes)

    def retrieve(self, documents: list[list[str]]) -> dict[tuple[int, int], float]:
        """(document, item) of all passages that reach the threshold, with the best score."""
        get = self.terms.get
        ids = np.array([get(w, -1) for words in documents for w in words], dtype=np.int64)
        length = np.array([len(words) for words in documents], dtype=np.int64)
        chunks = -(-length // self.chunk)
        first = np.cumsum(chunks) - chunks
        if not len(ids) or not len(self.terms):
            return {}
        owner = np.repeat(np.arange(len(documents)), length)
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
        chunk_of = first[owner] + inside // self.chunk
        known = ids >= 0
        pairs = np.unique(chunk_of[known] * len(self.terms) + ids[known])  # the terms of each chunk once
        chunk, term = np.divmod(pairs, len(self.terms))
        if not len(pairs):
            return {}
        n = int(chunks.sum())
        bounds = np.zeros((n + 1, self.block_max.shape[1]), dtype=np.float32)
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        bounds[chunk[starts]] = np.add.reduceat(self.block_max[term], starts, axis=0)
        document = np.repeat(np.arange(len(documents)), chunks)
        follows = np.r_[document[1:] == document[:-1], False] if n else np.zeros(0, bool)
        limit = 1 - 1e-4  # single-precision sums
        window, block = np.nonzero(bounds[:-1] + np.where(follows[:, None], bounds[1:], 0) >= limit)
        begin = np.searchsorted(chunk, np.arange(n + 2))
        best: dict[tuple[int, int], float] = {}
        cuts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else []
        for a, z in zip(cuts, [*cuts[1:], len(window)]):
            w = int(window[a])
            held = np.unique(term[begin[w] : begin[w + 1 + bool(follows[w])]])
            columns = (block[a:z, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = self.weight[held[:, None], columns].sum(axis=0)
            for c in np.flatnonzero(score >= limit):
                key = (int(document[w]), int(columns[c]))
                best[key] = max(best.get(key, 0.0), float(score[c]))
        return best


class Verifier:
    """Shares of an item's shingles that a document holds."""

    def __init__(self, items: list[tuple[int, str, str]]):
        self.sets = {ident: tuple(shingles(tokens(t)) for t in (f"{q}\n{a}", q, a)) for ident, q, a in items}

    def overlaps(self, ident: int, held: set[tuple], words: set[str]) -> tuple[float, float, float]:
        def share(part: set[tuple]) -> float:
            short = {s for s in part if len(s) < SHINGLE}
            found = sum(s in held for s in part - short) + sum(self.runs(s, held, words) for s in short)
            return found / len(part) if part else 1.0

        return tuple(map(share, self.sets[ident]))

    @staticmethod
    def runs(short: tuple, held: set[tuple], words: set[str]) -> bool:
        """Whether a text of under five words occurs in a row."""
        n = len(short)
        return words.issuperset(short) and any(s[i : i + n] == short for s in held for i in range(len(s) - n + 1))


_MATCH = "item_id bigint, score double, overlap double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, tests: DataFrame, overlap: float = OVERLAP, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``item_id``, ``score``, ``overlap``, ``question_overlap``, ``answer_overlap``
    of every document and test item that share at least ``overlap`` of the item's shingles.

    ``tests`` has ``item_id``, ``text`` and perhaps ``answer``. Whole texts are searched. NULL
    and empty texts and items without a word match nothing; repeated rows match each for
    themselves; no item or no document gives no row. Items are grouped by id, lowest text first
    where an id repeats. The items are a test set: the driver reads them, checks their size and
    sends ``SCAN_CHARS`` of them at most with each scan of the documents.
    """
    answer = F.col("answer") if "answer" in tests.columns else F.lit(None).cast("string")
    wanted = tests.select("item_id", or_empty("text").alias("text"), answer.alias("answer")).filter("item_id IS NOT NULL").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    scans = 1 + size // SCAN_CHARS
    out = None
    for k in range(scans):
        mine = wanted if scans == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == k)
        items = {}
        for r in sorted(mine.collect(), key=lambda r: (r["item_id"], r["text"])):
            items.setdefault(r["item_id"], (r["item_id"], *((r["text"], r["answer"]) if r["answer"] else question_and_answer(r["text"]))))
        found = _scan(docs, [i for i in items.values() if tokens(i[1] + "\n" + i[2])], overlap, id_col)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs: DataFrame, items: list[tuple[int, str, str]], overlap: float, id_col: str) -> DataFrame:
    parts: list = []

    def match(batches):
        if not parts:
            ordered = [(ident, f"{q}\n{a}") for ident, q, a in items]
            parts.append([Part(ordered[i : i + PART]) for i in range(0, len(ordered), PART)])
            parts.append(Verifier(items))
        index, verifier = parts
        for batch in batches:
            texts = batch.column("text").to_pylist()
            source, rows = [], []
            for a, z in slices(texts):
                words = [tokens(t) for t in texts[a:z]]
                held: dict[int, tuple[set, set]] = {}
                for part in index:
                    for (d, i), score in sorted(part.retrieve(words).items()):
                        if d not in held:
                            held[d] = (shingles(words[d]), set(words[d]))
                        ident = part.items[i][0] if i < len(part.items) else None
                        shares = verifier.overlaps(ident, *held[d])
                        if shares[0] >= overlap:
                            source.append(a + d)
                            rows.append((ident, score * SCORE_SHARE, *shares))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = [id_col, "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    return docs.select(id_col, or_empty("text").alias("text")).mapInArrow(match, f"{id_col} {dict(docs.dtypes)[id_col]}, {_MATCH}")


def slices(texts: list[str], most: int = 2_000_000):
    """Consecutive slices with a bounded number of characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def drop_leaks(docs: DataFrame, tests: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that match no test item; edge cases as in ``find_leaks``."""
    rows = numbered(docs, "leak-rows")
    leaks = find_leaks(rows, tests, overlap, ROW).select(ROW).distinct()
    return rows.join(leaks, ROW, "left_anti").select(docs.columns)


def _grams(name: str, source: str, ident: str, text: str) -> str:
    found = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    lead = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, SHINGLE))
    return f"""{name} AS (
  SELECT DISTINCT {ident}, CASE WHEN n < {SHINGLE} THEN list_aggregate(ws, 'string_agg', ' ') ELSE concat_ws(' ', w, {lead}) END AS gram
  FROM (SELECT {ident}, ws, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT {ident}, {found} AS ws FROM {source}))
  WINDOW o AS (PARTITION BY {ident} ORDER BY pos) QUALIFY n < {SHINGLE} OR pos <= n - {SHINGLE - 1})"""


_SQL = f"""
WITH d AS (SELECT doc_id, text FROM documents),
{_grams('doc_grams', 'd', 'doc_id', 'text')},
{_grams('item_grams', 'benchmark', 'item_id', 'text')},
sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY 1)
SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS overlap
FROM doc_grams JOIN item_grams USING (gram) JOIN sizes USING (item_id)
GROUP BY 1, 2 HAVING count(*) >= {OVERLAP} * any_value(n)"""


@query("op7_decontamination", _SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))
