"""N-grams, tags, templates, samples and keywords from product text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X
from shelfmark.functions.text import STOPWORDS
from shelfmark.operators.encode import bucket, word_buckets
from shelfmark.session import spread, staged

#: Words that are frequent enough for n-grams, up to which they are sent to the documents.
FREQUENT_WORDS = 1000

# The words and patterns of each tag family.
TAG_FAMILIES = {
    "material": [
        "leather", "cotton", "polyester", "rubber", "nylon", "wood", "steel", "glass", "soft",
        "stretch", "durable", "lightweight", "handcrafted", "waterproof", "scratch[- ]?resistant",
        "machine[- ]?washable",
    ],
    "use": [
        "for (?:men|women|kids)", "unisex", "everyday use", "office", "travel", "casual", "formal",
        "gym", "workwear", "sleepwear", "loungewear",
    ],
    "features": [
        "uv protection", "eco[- ]?friendly", "wireless", "adjustable", "foldable", "ergonomic",
        "noise[- ]?cancelling", "battery[- ]?powered", "lightweight", "easy to clean", "compact",
        "space[- ]?saving", "made in [A-Z]{2,}",
    ],
    "vibes": [
        "elegant", "cozy", "sleek", "trendy", "classic", "vintage", "minimalist", "sporty",
        "relaxing", "professional", "bold", "modern", "artsy", "luxurious",
    ],
}


def tag_pattern(family: str, families: Mapping[str, Sequence[str]] = TAG_FAMILIES) -> str:
    return r"(?i)\b(?:" + "|".join(families[family]) + r")\b"


def clean_text(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, X.letters_only(F.col(column)))


def corpus_words(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Words of two letters or more, stopwords out, from cleaned text."""
    found = F.regexp_extract_all(X.letters_only(text), F.lit("[a-z]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~X.is_stopword(w, stopwords))


def top_ngrams(
    df: DataFrame, column: str, n_range: tuple[int, int] = (1, 1), k: int = 20, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """The k most frequent n-grams for n in the range; equal counts go by text.

    No n-gram is more frequent than any of its words. Where single words are asked for too, they are
    counted first, and longer n-grams only where each word reaches the count of the k-th word: the others
    cannot be among the k best. With more than ``FREQUENT_WORDS`` such words all n-grams are counted.
    """
    lists = spread(df.select(column)).select(corpus_words(F.col(column), stopwords).alias("_w"))
    order = F.col("n").desc(), F.col("ngram")
    if n_range[0] != 1 or n_range[1] < 2:
        return _gram_counts(lists, n_range).orderBy(*order).limit(k)
    words = staged(_gram_counts(lists, (1, 1)), "words")
    best = words.orderBy(*order).limit(k)
    least = best.agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n")).first()
    # With fewer than k words the least count that there is excludes nothing.
    frequent = [r["ngram"] for r in words.filter(F.col("n") >= least["n"]).select("ngram").limit(FREQUENT_WORDS + 1).collect()] if least["held"] == k and k else None
    fit = frequent is not None and len(frequent) <= FREQUENT_WORDS
    if fit:
        lists = lists.select(F.transform("_w", lambda w: F.when(w.isin(frequent), w)).alias("_w"))
    return best.unionByName(_gram_counts(lists, (2, n_range[1]), fit)).orderBy(*order).limit(k)


def _gram_counts(lists: DataFrame, n_range: tuple[int, int], gaps: bool = False) -> DataFrame:
    """``ngram, n`` of the word lists ``_w``. With ``gaps`` n-grams with a NULL word are not counted."""
    grams = F.concat(*[X.ngrams(F.col("_w"), n) for n in range(n_range[0], n_range[1] + 1)])
    if gaps:
        grams = F.filter(grams, lambda g: ~F.exists(g, lambda w: w.isNull()))
    rows = lists.select(X.rows_of(grams).alias("_g")).filter(F.col("_g").isNotNull())
    return rows.groupBy(F.array_join("_g", " ").alias("ngram")).agg(F.count(F.lit(1)).alias("n"))


def extract_tags(df: DataFrame, column: str, families: Mapping[str, Sequence[str]] = TAG_FAMILIES) -> DataFrame:
    """One sorted array of distinct tags per family, as ``tags_<family>``; other catalogs
    bring families of their own."""

    def tags(family: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(tag_pattern(family, families)), F.lit(0))
        return F.array_sort(F.array_distinct(F.transform(found, F.lower)))

    return df.withColumns({f"tags_{family}": tags(family) for family in families})


def merge_tags(df: DataFrame, families: Mapping[str, Sequence[str]] = TAG_FAMILIES) -> DataFrame:
    merged = F.flatten(F.array(*[F.col(f"tags_{family}") for family in families]))
    return df.withColumn("all_tags", F.array_join(F.array_sort(F.array_distinct(merged)), " "))


def combined_info(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``label: value, label: value`` with missing values as 'nan', as text templates of
    pandas rows show them."""
    parts = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for label, c in fields.items()]
    return df.withColumn("CombinedInfo", F.concat_ws(", ", *parts))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, ident: str | None = None) -> DataFrame:
    """About ``fraction`` of the rows. With ``ident`` a digest of that column decides, in steps of
    one in 10,000, so the sample is the same whatever the partitioning."""
    if ident is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.filter(bucket(F.col(ident).cast("string"), 10_000) < round(fraction * 10_000))


def keyword_extract(
    docs: DataFrame, k: int = 5, n_range: tuple[int, int] = (1, 3), dim: int = 256, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """The k candidate n-grams closest to their document, by cosine of hashed word counts.

    A document is one row, so it is counted and its candidates are scored where it lies, all n-grams
    of one length at once; only k of them leave the row. Ids have to be unique.
    """
    stops = frozenset(stopwords)
    out = T.StructType([docs.schema["pid"], T.StructField("rank", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("score", T.DoubleType())])

    def best(words: list[str], buckets: np.ndarray) -> list[tuple[float, str]]:
        counts = np.bincount(buckets, minlength=dim).astype(np.float64)
        length, weight = np.sqrt((counts * counts).sum()), counts[buckets]
        scores, sizes = [], []
        for n in range(n_range[0], min(n_range[1], len(words)) + 1):
            last = len(words) - n + 1
            dot = sum(weight[j : last + j] for j in range(n))
            # Words that share a bucket add up before squaring.
            shared = sum(((buckets[a : last + a] == buckets[b : last + b]) * 2 for a, b in combinations(range(n), 2)), np.zeros(last, np.int64))
            scores.append(np.round(dot / (np.sqrt(n + shared) * length), 6))
            sizes.append(np.full(last, n))
        if not scores:
            return []
        score, size, at = np.concatenate(scores), np.concatenate(sizes), np.concatenate([np.arange(len(s)) for s in scores])
        order = np.argsort(-score, kind="stable")
        found: set[tuple[float, str]] = set()
        for value, start, n in zip(score[order].tolist(), at[order].tolist(), size[order].tolist()):
            if len(found) >= k and value < last_kept:
                break
            found.add((-value, " ".join(words[start : start + n])))
            last_kept = value
        return sorted(found)[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, find, of = re.compile("[^a-z \\t\\n\\x0b\\f\\r]"), re.compile("[a-z]{2,}").findall, word_buckets(dim)
        for batch in batches:
            at, ranks, keywords, scores = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = [w for w in find(letters.sub("", text or "")) if w not in stops]
                if words:
                    for rank, (minus, keyword) in enumerate(best(words, np.array([of(w) for w in words])), 1):
                        at.append(i)
                        ranks.append(rank)
                        keywords.append(keyword)
                        scores.append(-minus)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ranks, pa.int32()), pa.array(keywords, pa.string()), pa.array(scores, pa.float64())], names=out.names
            )

    return spread(docs.select("pid", "document"), "pid").select("pid", F.lower("document").alias("document")).mapInArrow(run, out)
