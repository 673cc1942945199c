"""All-terms text search over a postings table (term, pid, tf, positions)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X
from shelfmark.functions.ranking import normalize_top, top_k
from shelfmark.functions.stemming import english_stem
from shelfmark.functions.text import STOPWORDS
from shelfmark.session import spread


#: Words whose terms a task remembers, and bytes of text that it takes at once, whole documents.
VOCABULARY = 200_000
CHUNK_BYTES = 1 << 19
#: Query terms that travel to the documents.
SENT_TERMS = 200_000


#: How words become terms: not at all, without plural endings, by the English stemmer.
STEMMERS = {False: str, True: X.stem_word, "english": english_stem}


class _Vocabulary:
    """Numbers of the terms of words, -1 for stopwords and terms that are not wanted. Words come again, so each
    is stemmed about once in a task."""

    def __init__(self, stops: frozenset[str], stemming: bool | str, only: frozenset[str] | None):
        self.stops, self.stem, self.only = stops, STEMMERS[stemming], only
        self.known: dict[str, int] = {}
        self.numbers: dict[str, int] = {}
        self.terms: list[str] = []

    def full(self) -> bool:
        return len(self.known) >= VOCABULARY

    def clear(self) -> None:
        self.known, self.numbers, self.terms = {}, {}, []

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        for word in set(words).difference(known):
            term = None if word in self.stops else self.stem(word)
            if term is None or (self.only is not None and term not in self.only):
                known[word] = -1
            else:
                known[word] = number = self.numbers.setdefault(term, len(self.terms))
                if number == len(self.terms):
                    self.terms.append(term)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch by ``CHUNK_BYTES``, each chunk with the number of its first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def _uses(texts: list[str | None], find: Callable[[str], list[str]], vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The uses of terms in a chunk: term, text and position of each, by term, text and position, and where
    the uses of a term in a text start."""
    found = [find(t or "") for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = vocabulary.ids([w for words in found for w in words])
    text = np.repeat(np.arange(len(found)), sizes)
    position = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    kept = np.flatnonzero(ids >= 0)
    key = ids[kept] * len(found) + text[kept]
    order = np.argsort(key, kind="stable")
    kept, key = kept[order], key[order]
    return ids[kept], text[kept], position[kept], np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def text_index(
    docs: DataFrame, stopwords: Sequence[str] = STOPWORDS, stemming: bool | str = True, unique_ids: bool = True, carry: Sequence[str] = (), only: frozenset[str] | None = None
) -> DataFrame:
    """Postings ``term, pid, *carry, tf, positions`` of ``docs(pid, document)``. Positions start
    at 1 and count stopwords too. A document is one row, so its postings are made where it
    lies: nothing is shuffled, and a word that is in every document is like any other.

    Ids have to be unique, as they are after ``dedup_first``; with ``unique_ids=False`` the
    postings of rows with one id are merged, which takes a shuffle of all postings. ``only``
    makes the postings of these terms alone.
    """
    names, stops = ["pid", *carry], frozenset(stopwords)
    rows = spread(docs.select(*names, "document"), "pid").select(*names, F.lower("document").alias("document"))
    fields = [T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    sent = docs.sparkSession.sparkContext.broadcast(only)
    out = T.StructType([T.StructField("term", T.StringType()), *(rows.schema[c] for c in names), *fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, vocabulary = re.compile(X.WORD).findall, _Vocabulary(stops, stemming, sent.value)
        for batch in batches:
            for first, texts in _chunks(batch.column(len(names))):
                ids, text, position, starts = _uses(texts, find, vocabulary)
                if len(starts):
                    used, which = np.unique(ids[starts], return_inverse=True)
                    terms = pa.array([vocabulary.terms[i] for i in used.tolist()], pa.string()).take(pa.array(which))
                    at, ends = pa.array(first + text[starts]), np.r_[starts, len(ids)]
                    held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position, pa.int32()))
                    yield pa.RecordBatch.from_arrays([terms, *(batch.column(i).take(at) for i in range(len(names))), pa.array(np.diff(ends)), held], names=out.names)
                if vocabulary.full():
                    vocabulary.clear()

    index = rows.mapInArrow(fold, out)
    if unique_ids:
        return index
    merged = index.groupBy("term", *names).agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return merged.select(*out.names)


def query_postings(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Postings of documents that have no index, for one batch of queries: the documents are read
    once and only terms of the queries leave them. More than ``SENT_TERMS`` terms are not
    sent; all postings are made then."""
    found = parsed.select(F.explode("terms").alias("term")).distinct().limit(SENT_TERMS + 1).collect()
    only = frozenset(r["term"] for r in found) if len(found) <= SENT_TERMS else None
    return text_index(docs, only=only)


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def parse_queries(queries: DataFrame, stopwords: Sequence[str] = STOPWORDS, stemming: bool | str = True) -> DataFrame:
    """(query_id, terms, n_terms); a query without terms matches nothing and is left out."""
    if stemming == "english":
        parsed = _stemmed(queries.select("query_id", X.query_terms(F.col("text"), stopwords, False).alias("terms")))
    else:
        parsed = queries.select("query_id", X.query_terms(F.col("text"), stopwords, stemming).alias("terms"))
    return parsed.withColumn("n_terms", F.size("terms")).filter(F.col("n_terms") > 0)


def _stemmed(rows: DataFrame) -> DataFrame:
    """The distinct stems of ``terms``, in order of first use."""

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [None if t is None else list(dict.fromkeys(map(english_stem, t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=names)

    return rows.mapInArrow(run, rows.schema)


def english_stems(words: DataFrame) -> DataFrame:
    """``word, stem`` for distinct words, by the English stemmer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w is None else english_stem(w) for w in found], pa.string())], names=["word", "stem"])

    return words.select("word").mapInArrow(run, "word string, stem string")


def _rarest_term(parsed: DataFrame, stats: DataFrame) -> DataFrame:
    """Each query with its rarest term; queries with an unknown term are dropped."""
    terms = parsed.select("query_id", "n_terms", F.explode("terms").alias("term"))
    return (
        terms.join(stats, "term")
        .groupBy("query_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("_known"), F.min_by("term", F.struct("df", "term")).alias("_rarest"))
        .filter(F.col("_known") == F.col("n_terms"))
        .select("query_id", "_rarest")
    )


def matched_postings(
    postings: DataFrame,
    parsed: DataFrame,
    stats: DataFrame | None = None,
    columns: Sequence[str] = ("tf",),
) -> DataFrame:
    """Rows (query_id, n_terms, pid, term, *columns) of the query terms in every product
    that could match; a product matches where the group has ``n_terms`` rows.

    Only products holding the query's *rarest* term are looked at; the other terms are
    then probed by (term, pid), which is an evenly spread key. A term that occurs in a
    third of the catalog therefore never builds its full list per query.
    """
    wanted = parsed.select(F.explode("terms").alias("term")).distinct()
    useful = postings.select("term", "pid", *columns).join(wanted, "term", "left_semi")
    stats = stats if stats is not None else term_stats(useful)
    anchored = parsed.join(_rarest_term(parsed, stats), "query_id")
    candidates = anchored.join(
        useful.select(F.col("term").alias("_rarest"), "pid"), "_rarest"
    ).select("query_id", "pid", "n_terms", F.explode("terms").alias("term"))
    return candidates.join(useful, ["term", "pid"])


def all_terms(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per (query, product) in which every query term occurs."""
    grouped = rows.groupBy("query_id", "pid", "n_terms").agg(F.count(F.lit(1)).alias("_found"), *aggregates)
    return grouped.filter(F.col("_found") == F.col("n_terms")).drop("_found")


def match_all_terms(postings: DataFrame, parsed: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    return all_terms(matched_postings(postings, parsed, stats, []))


def damped_count(tf: Column) -> Column:
    """1 + 1/4 + 1/9 + ... up to tf terms."""
    steps = F.sequence(F.lit(1), tf.cast("int"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + F.lit(1.0) / (j * j))


def score_frequency(rows: DataFrame) -> DataFrame:
    """``query_id, pid, score`` from the matched postings of whole candidates."""
    scored = all_terms(rows, F.sum(damped_count(F.col("tf"))).alias("_sum"))
    return scored.select("query_id", "pid", (F.col("_sum") / F.col("n_terms")).alias("score"))


def rank_frequency(postings: DataFrame, parsed: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """More occurrences score higher, each further one by less."""
    return score_frequency(matched_postings(postings, parsed, stats))


def _cover_score(places: Column, n_terms: Column) -> Column:
    """Sum of 1 / (1 + noise) over the minimal covers of one sorted place list.

    ``places`` holds (position, term number). Walking right, ``last`` keeps where each
    term was seen last; the leftmost of these opens the tightest cover that ends here,
    and it is a new minimal cover exactly when that opening has moved.
    """
    start = F.struct(
        F.array_repeat(F.lit(-1), n_terms).alias("last"),
        F.lit(-1).alias("opening"),
        F.lit(0).alias("i"),
        F.lit(0.0).alias("score"),
    )

    def step(acc: Column, place: Column) -> Column:
        last = F.transform(acc["last"], lambda seen, t: F.when(t == place["term_no"], acc["i"]).otherwise(seen))
        opening = F.array_min(last)
        moved = opening > acc["opening"]
        span = place["position"] - F.get(places, F.greatest(opening, F.lit(0)))["position"]
        noise = span - (acc["i"] - opening)
        return F.struct(
            last.alias("last"),
            F.greatest(opening, acc["opening"]).alias("opening"),
            (acc["i"] + 1).alias("i"),
            (acc["score"] + F.when(moved, F.lit(1.0) / (1 + noise)).otherwise(F.lit(0.0))).alias("score"),
        )

    return F.aggregate(places, start, step, lambda acc: acc["score"])


def score_cover_density(rows: DataFrame) -> DataFrame:
    """``query_id, pid, score`` from matched postings with ``positions``."""
    numbered = F.flatten(
        F.transform(
            "hits",
            lambda hit, t: F.transform(
                hit["positions"], lambda p: F.struct(p.alias("position"), t.cast("int").alias("term_no"))
            ),
        )
    )
    matched = all_terms(rows, F.collect_list(F.struct("term", "positions")).alias("hits"))
    placed = matched.select("query_id", "pid", "n_terms", F.array_sort(numbered).alias("places"))
    return placed.select("query_id", "pid", _cover_score(F.col("places"), F.col("n_terms")).alias("score"))


def rank_cover_density(postings: DataFrame, parsed: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Terms that stand closer together score higher (Clarke, Cormack & Tudhope 2000)."""
    return score_cover_density(matched_postings(postings, parsed, stats, ["positions"]))


def score_tfidf(rows: DataFrame, n_docs: Column) -> DataFrame:
    """``query_id, pid, score`` from matched postings with ``df``."""
    weight = F.col("tf") * F.ln((n_docs + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))
    return all_terms(rows, F.sum(weight).alias("score")).drop("n_terms")


def rank_tfidf(postings: DataFrame, parsed: DataFrame, n_docs: Column, stats: DataFrame | None = None) -> DataFrame:
    stats = stats if stats is not None else term_stats(postings)
    return score_tfidf(matched_postings(postings, parsed, stats).join(stats, "term"), n_docs)


def text_topk(scored: DataFrame, k: int) -> DataFrame:
    return normalize_top(top_k(scored, k), style="text")
