"""Removal of passages that an earlier document holds, by parsing relative to indexed blocks.

A document is factored against the text of all documents. The reference is cut into blocks by
content: every window of words belongs to the block of its seed, the least gram in it, so the one
block that can hold a copy of a window is known without looking, and consecutive windows with
one seed travel as one phrase. A block indexes its windows with the first document of each and
factors the phrases of the others greedily: a factor is the longest run of windows that the index
holds for an earlier document. Phrases of a document overlap by all but one word, so windows
across factor boundaries are checked like any other, and factors that meet are joined again.

Words are compared by 64-bit hash; a window is its seed and 48 bits more, 112 in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.base import WORD, query, table

#: Words of a window, the least length of a factor.
WINDOW = 13
#: Words of a gram, of which the least in a window is its seed.
GRAM = 3
#: Bytes that tell the windows of a seed apart.
TAG = 6
#: Words that a task parses at once, and words of one text that are held as strings.
CHUNK_WORDS = 1_000_000
TEXT_WORDS = 500_000
#: Grams above this share of a sample are seeds only where a window has no other. It bounds their list.
COMMON = 1 / 20_000
#: The sample: first documents of each partition. It decides which block a window goes to, not the result.
SAMPLED = 16

_R = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * _R + words[j : len(words) - n + 1 + j]
    return _mixed(out)


def _hashed(words: list[str]) -> np.ndarray:
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return known[coded.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after the other, and the words of each text."""
    counts, done, held, n_held = np.zeros(len(texts), dtype=np.int64), [], [], 0
    for i, text in enumerate(texts):
        found = (m.group() for m in WORD.finditer(text)) if text and len(text) > TEXT_WORDS else iter(WORD.findall(text or ""))
        while part := list(islice(found, TEXT_WORDS)):
            counts[i] += len(part)
            held.append(part)
            n_held += len(part)
            if n_held >= TEXT_WORDS:
                done.append(_hashed(list(chain.from_iterable(held))))
                held, n_held = [], 0
    done.append(_hashed(list(chain.from_iterable(held))))
    return np.concatenate(done), counts


class Phrases:
    """The windows of a chunk of documents as phrases: runs of windows with one seed."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, common: np.ndarray):
        grams, windows = _rolled(words, GRAM), _rolled(words, WINDOW)
        key = grams >> np.uint64(1)
        if len(common):
            place = np.minimum(np.searchsorted(common, key), len(common) - 1)
            key |= (common[place] == key).astype(np.uint64) << np.uint64(63)
        m = len(windows)
        seed, at = key[:m].copy(), np.arange(m)
        for j in range(1, WINDOW - GRAM + 1):
            less = key[j : m + j] < seed
            seed[less] = key[j : m + j][less]
            at[less] = np.flatnonzero(less) + j
        first = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)[:m]
        inside = np.flatnonzero(np.arange(m) + WINDOW <= (first + counts)[doc])  # windows do not cross documents
        self.windows, self.doc, at = windows[inside], doc[inside], at[inside]
        self.place = inside - first[self.doc]
        self.begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
        self.seed = seed[inside][self.begin]
        self.n = np.diff(np.r_[self.begin, len(inside)])

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Phrases that an earlier document of the chunk holds as they are."""
        head, tail = self.windows[self.begin], self.windows[self.begin + self.n - 1]
        owner = ids[self.doc[self.begin]]
        order = np.lexsort((owner, self.n, tail, head))
        same = (head[order][1:] == head[order][:-1]) & (tail[order][1:] == tail[order][:-1]) & (self.n[order][1:] == self.n[order][:-1])
        start = np.flatnonzero(np.r_[True, ~same])
        least = np.repeat(owner[order][start], np.diff(np.r_[start, len(order)]))
        out = np.zeros(len(order), dtype=bool)
        out[order] = owner[order] > least
        return out

    def tags(self, chosen: np.ndarray) -> pa.Array:
        """The tags of the windows of each chosen phrase."""
        raw = self.windows.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TAG]
        keep = np.repeat(chosen, self.n)
        offsets = np.r_[0, np.cumsum(self.n[chosen]) * TAG].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), int(chosen.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[keep]))])


def _runs(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of the runs of true flags; a run does not go on over a break."""
    starts = np.flatnonzero(flag & np.r_[True, ~flag[:-1] | breaks[1:]]) if len(flag) else np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(flag & np.r_[~flag[1:] | breaks[1:], True]) if len(flag) else starts
    return starts, ends - starts + 1


def _keys(docs: DataFrame, ids: str, text: str) -> list[Column]:
    """The id, a missing one last, and a mark that tells texts of one id apart. Where ids are unique, which
    a look at the ids alone shows, they need none, and phrases are shorter rows."""
    if not isinstance(docs.schema[ids].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{ids} must be an integer: documents are earlier by their number")
    unique = docs.groupBy(ids).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).isEmpty()
    mark = F.lit(0) if unique else F.hash(F.coalesce(F.col(text), F.lit("")))
    return [F.coalesce(F.col(ids).cast("bigint"), F.lit(_LAST)).alias("_doc"), mark.alias("_mark")]


def common_grams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Grams above the share ``COMMON`` of a sample, so ``1 / COMMON`` of them at most."""

    def count(batches):
        for batch in batches:
            words, counts = word_hashes(batch.column(0).slice(0, SAMPLED).to_pylist())
            grams, n = np.unique(_rolled(words, GRAM) >> np.uint64(1), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[grams[often], 1 << 63].astype(np.uint64).view(np.int64)), pa.array(np.r_[n[often], n.sum()].astype(np.int64))], names=["gram", "n"])
            return

    counted = docs.select(text).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    whole = F.max(F.when(F.col("gram") == -(1 << 63), F.col("n")))
    total = counted.agg(whole.alias("n")).first()["n"] or 0
    rows = counted.filter((F.col("gram") >= 0) & (F.col("n") > max(1, COMMON * total))).collect()
    return np.sort(np.array([r["gram"] for r in rows], dtype=np.int64)).view(np.uint64)


def _phrases(docs: DataFrame, keys: list[Column], text: str, common: np.ndarray) -> DataFrame:
    """Phrases with their seed, document, ``where`` (mark and first word) and tags. Phrases that an earlier document of
    the same chunk holds are decided already: they have ``n`` windows and no tags."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), *word_hashes(part.column(2).to_pylist())))
                size += len(held[-1][2])
                if size >= CHUNK_WORDS:
                    yield from chunk(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from chunk(*map(np.concatenate, zip(*held)))

    def chunk(doc: np.ndarray, mark: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = Phrases(words, counts, sent.value)
        if not len(found.n):
            return
        known = found.known(doc)
        open_ = ~known
        whose = found.doc[found.begin]
        at, length = _runs(known, np.r_[False, whose[1:] != whose[:-1]])
        before = np.r_[0, np.cumsum(found.n)]
        many = before[at + length] - before[at]
        picked = np.r_[np.flatnonzero(open_), at]
        first = found.begin[picked]
        owner = found.doc[first]
        place = found.place[first]
        # Decided runs need no block: any one passes them on.
        seed = np.r_[found.seed[open_], _mixed(doc[found.doc[found.begin[at]]].view(np.uint64) * _R + found.place[found.begin[at]].astype(np.uint64))]
        n = np.r_[np.zeros(int(open_.sum()), dtype=np.int64), many]
        tags = pa.concat_arrays([found.tags(open_), pa.array([b""] * len(at), pa.binary())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seed.view(np.int64)), pa.array(doc[owner]), pa.array(mark[owner].astype(np.int64) << 32 | place), pa.array(n.astype(np.int32)), tags],
            names=["seed", "_doc", "where", "n", "tags"],
        )

    rows = docs.select(*keys, text)
    # The mark and the place share a column: many narrow rows are shuffled.
    return rows.mapInArrow(cut, "seed bigint, _doc bigint, where bigint, n int, tags binary")


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The factors of the phrases of a block, which come by seed and document. Only the index of
    the seed at hand is kept: its windows and the first document of each."""
    last_seed, last_tags, last_docs = None, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        seed, doc, where, n = (batch.column(i).to_numpy() for i in range(4))
        tags, mark, place = batch.column(4), (where >> 32).astype(np.int32), where & 0xFFFFFFFF
        offsets = np.frombuffer(tags.buffers()[1], np.int32)[tags.offset : tags.offset + len(tags) + 1]
        count = np.diff(offsets) // TAG
        raw = np.zeros((int(count.sum()), 8), dtype=np.uint8)
        if len(raw):
            raw[:, :TAG] = np.frombuffer(tags.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, TAG)
        tag = raw.view("<u8").ravel()
        group = np.cumsum(np.r_[0, seed[1:] != seed[:-1]])
        row = np.repeat(np.arange(len(seed)), count)
        going_on = len(seed) > 0 and last_seed == seed[0]
        old = len(last_tags) if going_on else 0
        all_tags = np.r_[last_tags[:old], tag]
        all_docs = np.r_[last_docs[:old], doc[row]]
        all_groups = np.r_[np.zeros(old, dtype=np.int64), group[row]]
        order = np.lexsort((all_tags, all_groups))  # stable, so documents stay in order
        t, g, d = all_tags[order], all_groups[order], all_docs[order]
        start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]) if len(t) else np.zeros(0, dtype=np.int64)
        first = np.repeat(d[start], np.diff(np.r_[start, len(t)]))
        held = np.zeros(len(t), dtype=bool)
        held[order] = d > first
        if len(seed):
            mine = start[g[start] == group[-1]]
            if going_on and not len(mine) and group[-1] == 0:
                pass  # only decided runs in this batch
            else:
                last_tags, last_docs = t[mine], d[mine]
            last_seed = seed[-1]
        at, length = _runs(held[old:], np.r_[False, row[1:] != row[:-1]] if len(row) else held[old:])
        inner = at - (np.cumsum(count) - count)[row[at]]
        decided = np.flatnonzero(n > 0)
        owner = np.r_[row[at], decided]
        if len(owner):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[owner]), pa.array(mark[owner]), pa.array(np.r_[place[row[at]] + inner, place[decided]].astype(np.int32)), pa.array(np.r_[length, n[decided]].astype(np.int32))],
                names=["_doc", "_mark", "place", "n"],
            )


def factors(docs: DataFrame, keys: list[Column], text: str = "text") -> DataFrame:
    """The factors ``_doc, _mark, place, n``: n windows from word ``place`` on that an earlier document holds.
    ``keys`` are the columns ``_doc`` and ``_mark``."""
    found = _phrases(docs, keys, text, common_grams(docs, text))
    return found.repartition("seed").sortWithinPartitions("seed", "_doc").mapInArrow(_factored, "_doc bigint, _mark int, place int, n int")


def drop_repeats(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of windows of ``WINDOW`` words that also start in a document with a
    smaller id; the words left are joined by one space. ``n_words``, ``n_removed`` and ``spans``
    (``start`` and ``end`` of the removed words) are added, or replaced where ``docs`` has them.

    Windows are judged on the input. A NULL text stays NULL and has no words; empty and short
    texts lose nothing. Rows with one id, repeated ones too, are not held against each other;
    a NULL id is later than all numbers. An empty table stays empty. A text is read
    whole: a task holds 8 bytes for each word of a chunk, and its index the different windows
    around one gram.
    """
    keys = _keys(docs, ids, text)
    spans = factors(docs, keys, text).groupBy("_doc", "_mark").agg(F.collect_list(F.struct("place", "n")).alias("_spans"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "spans")]
    keyed = docs.select(*kept, *keys).join(spans, ["_doc", "_mark"], "left").select(*kept, "_spans")
    where = kept.index(text)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, removed, cuts = [], [], [], []
            for value, own in zip(batch.column(where).to_pylist(), batch.column(len(kept)).to_pylist()):
                found = WORD.findall(value or "")
                cut: list[list[int]] = []
                for a, b in sorted((s["place"], s["place"] + s["n"] + WINDOW - 1) for s in own or ()):
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], b)
                    else:
                        cut.append([a, b])
                words.append(len(found))
                removed.append(sum(b - a for a, b in cut))
                cuts.append([{"start": a, "end": b} for a, b in cut])
                for a, b in reversed(cut):
                    del found[a:b]
                texts.append(None if value is None else " ".join(found))
            columns = [batch.column(i) for i in range(len(kept))]
            columns[where] = pa.array(texts, columns[where].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, arrow_span)], names=[*kept, "n_words", "n_removed", "spans"])

    return keyed.mapInArrow(left, out)


_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS p FROM docs)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY 1),
held AS (SELECT r, p FROM windows JOIN firsts USING (h) WHERE first_doc IS NOT NULL AND (doc_id IS NULL OR doc_id > first_doc)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
marked AS (
  SELECT r, word, p, coalesce(max(held.p) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS cut
  FROM words LEFT JOIN held USING (r, p)),
cleaned AS (SELECT r, string_agg(word, ' ' ORDER BY p) FILTER (NOT cut) AS kept, count(*) FILTER (cut) AS n_removed FROM marked GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN cleaned USING (r)"""


@query("op13_substring_dedup", _SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one holds."""
    docs = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
