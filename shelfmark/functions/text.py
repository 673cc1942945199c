"""Tokens, stopwords, stems and n-grams as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"

# The common English stopword list of the public Snowball project,
# as full-text engines ship it.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def rows_of(values: Column | str) -> Column:
    """One row per entry, NULL for none: filter that out afterwards. A plain ``explode``
    lets the optimizer test ``size(values) > 0`` as early as in the scan, which computes
    costly token lists twice, and the first time before the rows are spread."""
    return F.explode_outer(values)


def is_stopword(word: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return word.isin(list(stopwords))


def stem(word: Column) -> Column:
    """Plural stripping after Harman (1991): the first rule that applies, once."""


    def ends(*tails: str) -> Column:
        hit = word.endswith(tails[0])
        for tail in tails[1:]:
            hit = hit | word.endswith(tail)
        return hit

    length = F.length(word)
    return (
        F.when((length <= 3) | ~ends("s"), word)
        .when(ends("ies") & ~ends("eies", "aies"), F.concat(F.left(word, length - 3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), F.left(word, length - 1))
        .when(ends("us", "ss"), word)
        .otherwise(F.left(word, length - 1))
    )


def stem_word(word: str) -> str:
    """``stem`` for one string, for work that is done inside a task."""
    if len(word) <= 3 or not word.endswith("s"):
        return word
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    return word if word.endswith(("us", "ss")) else word[:-1]


def query_terms(text: Column, stopwords: Sequence[str] = STOPWORDS, stemming: bool = True) -> Column:
    """The distinct search terms of a text, in order of first use."""
    kept = F.filter(words(text), lambda w: ~is_stopword(w, stopwords))
    return F.array_distinct(F.transform(kept, stem) if stemming else kept)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z\s]", "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n neighbouring tokens as arrays. ``tokens`` has to be a plain column:
    entries are picked by index, as ``slice`` inside a lambda copies the whole list."""
    last = F.size(tokens) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array(*[F.get(tokens, i + j) for j in range(n)]))
