"""All-terms search of many queries in the postings of some documents, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfmark.schema import SCORE_DECIMALS

#: Documents that are scored first, for each result wanted.
FIRST = 4


def ids_in_order(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids in order, and the place of each row's id there."""
    coded = ids.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def score_key(score: np.ndarray) -> np.ndarray:
    """The score at the precision that ranks are decided on, as whole numbers."""
    return np.floor(score * 10**SCORE_DECIMALS + 0.5)


def damped_counts(tf: np.ndarray) -> np.ndarray:
    """1 + 1/4 + 1/9 + ... up to tf terms."""
    steps = np.arange(1, tf.max(initial=0) + 1, dtype=np.float64)
    return np.r_[0.0, np.cumsum(1.0 / (steps * steps))][tf]


def plain_counts(tf: np.ndarray) -> np.ndarray:
    return tf.astype(np.float64)


@dataclass
class Postings:
    """Postings in the order of their terms' numbers, then of documents, which are numbers too. A document has a
    term once."""

    document: np.ndarray
    tf: np.ndarray
    start: np.ndarray  # of each posting's places
    positions: np.ndarray


def frequency(held: Postings, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``found`` has a row per term and a column per matching document: the places of their postings. Columns and scores
    of all that can be among the k best."""
    score = damped_counts(held.tf[found]).sum(axis=0) / len(found)
    return np.arange(found.shape[1]), score


def _cover_scores(held: Postings, found: np.ndarray) -> np.ndarray:
    """Sums of 1 / (1 + noise) over the minimal covers in each document. Of the last places of all terms up to a place,
    the first opens the tightest cover that ends there; it is a new one where that has moved."""
    flat = found.T.ravel()
    tf = held.tf[flat].astype(np.int64)
    ends = np.cumsum(tf)
    at = np.arange(ends[-1]) - np.repeat(ends - tf, tf)
    position = held.positions[np.repeat(held.start[flat], tf) + at].astype(np.int64)
    document = np.repeat(np.arange(found.shape[1]), tf.reshape(found.T.shape).sum(axis=1))
    term = np.repeat(np.tile(np.arange(len(found)), found.shape[1]), tf)
    order = np.argsort((document << 32) | position, kind="stable")
    position, term, place = position[order], term[order], np.arange(len(order))
    opening = place
    for t in range(len(found)):
        opening = np.minimum(opening, np.maximum.accumulate(np.where(term == t, place, -1)))
    first = np.searchsorted(document, document)  # the first place of the document
    new = np.flatnonzero((opening >= first) & (opening != np.r_[-1, opening[:-1]]))
    noise = position[new] - position[opening[new]] - (new - opening[new])
    return np.bincount(document[new], 1.0 / (1 + noise), found.shape[1])


def cover_density(held: Postings, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by covers. Only documents whose bound, by their counts, reaches the k-th score found are scored."""
    tf, n = held.tf[found].astype(np.int64), len(found)
    bound = np.minimum(tf.sum(axis=0) - n + 1, n * tf.min(axis=0))
    if found.shape[1] <= FIRST * k:
        return np.arange(found.shape[1]), _cover_scores(held, found)
    first = np.argpartition(-bound, FIRST * k - 1)[: FIRST * k]
    scores = _cover_scores(held, found[:, first])
    kth = np.partition(score_key(scores), -k)[-k]
    reach = score_key(bound + 1e-9) >= kth
    reach[first] = False
    later = np.flatnonzero(reach)
    if not len(later):
        return first, scores
    return np.r_[first, later], np.r_[scores, _cover_scores(held, found[:, later])]


def k_best(key: np.ndarray, document: np.ndarray, k: int) -> np.ndarray:
    """The k highest, equal ones by document."""
    if len(key) > k:
        some = np.flatnonzero(key >= np.partition(key, -k)[-k])
    else:
        some = np.arange(len(key))
    return some[np.lexsort((document[some], -key[some]))][:k]


@dataclass
class Sets:
    """Queries as sets of term numbers, one after the other."""

    query_id: np.ndarray
    term: np.ndarray
    start: np.ndarray
    terms: int


def searched(blobs: list[dict[str, pa.Array]], sets: Sets, score: Callable, k: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``query_id, pid, score`` of the k best documents of each query among the documents of the blobs, which have
    all their postings. Documents that have a term twice, in rows of one id, match nothing."""
    number = np.concatenate([b["number"].to_numpy() for b in blobs])
    tf = np.concatenate([b["tf"].to_numpy() for b in blobs])
    positions = np.concatenate([b["positions"].to_numpy() for b in blobs])
    ids, document = ids_in_order(pa.concat_arrays([b["pid"] for b in blobs]))
    order = np.argsort(number.astype(np.int64) * len(ids) + document, kind="stable")
    number, document = number[order], document[order]
    same = (number[1:] == number[:-1]) & (document[1:] == document[:-1])
    once = np.flatnonzero(~(np.r_[False, same] | np.r_[same, False])) if len(order) else order
    number, order = number[once], order[once]
    start = np.cumsum(tf, dtype=np.int64) - tf
    held = Postings(document[once], tf[order], start[order], positions)
    starts = np.searchsorted(number, np.arange(sets.terms + 1))
    sizes = np.diff(starts)
    ends, found, best, scores = np.r_[sets.start[1:], len(sets.term)], [], [], []
    for i in np.flatnonzero(np.minimum.reduceat(sizes[sets.term], sets.start) > 0).tolist():
        terms = sets.term[sets.start[i] : ends[i]]
        terms = terms[np.argsort(sizes[terms], kind="stable")]
        rows = np.arange(starts[terms[0]], starts[terms[0] + 1])[None]
        for t in terms[1:]:
            wanted, others = held.document[rows[0]], held.document[starts[t] : starts[t + 1]]
            at = np.minimum(np.searchsorted(others, wanted), len(others) - 1)
            hit = np.flatnonzero(others[at] == wanted)
            rows = np.r_[rows[:, hit], [at[hit] + starts[t]]]
            if not len(hit):
                break
        if rows.shape[1]:
            columns, value = score(held, rows, k)
            who = held.document[rows[0][columns]]
            chosen = k_best(score_key(value), who, k)
            found.append(np.full(len(chosen), sets.query_id[i]))
            best.append(who[chosen])
            scores.append(value[chosen])
    if found:
        yield np.concatenate(found), ids.take(pa.array(np.concatenate(best))), np.concatenate(scores)


def best_alone(query: np.ndarray, pid: pa.Array, tf: np.ndarray, score: Callable, k: int) -> np.ndarray:
    """The rows of the k best documents of each one-term query, without those of documents that come twice."""
    _, document = ids_in_order(pid)
    order = np.lexsort((document, query))
    same = (query[order][1:] == query[order][:-1]) & (document[order][1:] == document[order][:-1])
    order = order[~(np.r_[False, same] | np.r_[same, False])[: len(order)]]
    order = order[np.lexsort((document[order], -score_key(score(tf[order])), query[order]))]
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]
