"""Task-side top-k: scores of a block of candidates, best k per query kept.

Spark decides which rows meet in which task; this module only scores one block
with numpy and forgets what cannot be in the answer. Order is by score
descending, then by candidate id; a missing score comes last.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_ROWS = 512
VECTOR_ROWS = 8192


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector")
    lengths = pc.min_max(pc.list_value_length(column))
    if lengths["min"] != lengths["max"]:
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines rounded to 6 decimals; NaN where a vector is zero."""
    lengths = np.einsum("ij,ij->i", left, left)[:, None] * np.einsum("ij,ij->i", right, right)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(left @ right.T / np.sqrt(lengths), 6) + 0.0


def _cut(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the best k of each query."""
    worst_last = np.where(np.isnan(score), -np.inf, score)
    order = np.lexsort((tie, -worst_last, query))
    ordered = query[order]
    first = np.searchsorted(ordered, ordered, side="left")
    return order[np.arange(len(order)) - first < k]


def _best_of_scores(scores: np.ndarray, ids: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of each row of ``scores``, whose columns are the rows of ``ids``: query,
    score, row of ``ids``."""
    by_id = pc.sort_indices(ids.column(0)).to_numpy()
    scores = scores[:, by_id]
    key = np.where(np.isnan(scores), -np.inf, scores)
    n = key.shape[1]
    if n > k:
        bar = np.partition(key, n - k, axis=1)[:, n - k]
        query, at = np.nonzero(key >= bar[:, None])
    else:
        query, at = (part.ravel() for part in np.indices(key.shape))
    score = scores[query, at]
    best = _cut(query, score, at, k)
    return query[best], score[best], by_id[at[best]].astype(np.int64)


class TopK:
    """Best k candidates of each query over a stream of scored blocks."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.ids: pa.Table | None = None
        self.settled = 0

    def add(self, first_query: int, scores: np.ndarray, ids: pa.Table) -> None:
        """``scores[i, j]`` is query ``first_query + i`` against row j of ``ids``;
        the first column of ``ids`` breaks ties."""
        if ids.num_rows == 0:
            return
        query, score, at = _best_of_scores(scores, ids, self.k)
        self.add_rows(query + first_query, score, ids.take(pa.array(at)))

    def add_rows(self, query: np.ndarray, score: np.ndarray, ids: pa.Table) -> None:
        """Scored pairs, one a row: the number of the query, the score, the candidate's ids."""
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, score])
        self.ids = ids if self.ids is None else pa.concat_tables([self.ids, ids])
        if len(self.query) > max(4 * self.settled, 100_000):
            self._settle()

    def _settle(self) -> None:
        tie = pc.rank(self.ids.column(0), tiebreaker="dense").to_numpy()
        best = _cut(self.query, self.score, tie, self.k)
        self.query, self.score = self.query[best], self.score[best]
        self.ids = self.ids.take(pa.array(best)).combine_chunks()
        self.settled = len(self.query)

    def table(
        self, query_ids: pa.Array | pa.ChunkedArray, query_name: str, score_name: str
    ) -> pa.Table | None:
        if self.ids is None:
            return None
        self._settle()
        score = pa.array(self.score, from_pandas=True)
        out = self.ids.append_column(score_name, score)
        return out.add_column(0, query_name, query_ids.take(pa.array(self.query)))


# Above so many pairs of a slice that single precision cannot tell apart, all are scored.
MOST_PAIRS = 100_000
PAIR_ROWS = 16_384


def cosine_block(best: TopK, queries: np.ndarray, vectors: np.ndarray, ids: pa.Table) -> None:
    """Score two blocks in slices, so memory does not grow with their product.

    Pairs are compared in single precision first. Those that can be among the best k by
    its error bound are scored in double precision; the answer is the same. Vectors whose
    length is zero, missing or extreme are scored with everything.
    """
    asked, held = _usual(queries), _usual(vectors)
    _score_all(best, queries, vectors, ids, np.arange(len(queries)), np.flatnonzero(~held))
    _score_all(best, queries, vectors, ids, np.flatnonzero(~asked), np.flatnonzero(held))
    rows, at = np.flatnonzero(asked), np.flatnonzero(held)
    if not len(rows) or not len(at):
        return
    by_id = at[pc.sort_indices(ids.column(0).take(pa.array(at))).to_numpy()]
    vectors = vectors[by_id]
    units = _units(vectors)
    for start in range(0, len(rows), QUERY_ROWS):
        row = rows[start : start + QUERY_ROWS]
        query, score, place = _best_of_usual(queries[row], vectors, units, best.k)
        best.add_rows(row[query], score, ids.take(pa.array(by_id[place])))


def _score_all(
    best: TopK, queries: np.ndarray, vectors: np.ndarray, ids: pa.Table, rows: np.ndarray, at: np.ndarray
) -> None:
    for start in range(0, len(at), VECTOR_ROWS):
        part = at[start : start + VECTOR_ROWS]
        held, held_ids = vectors[part], ids.take(pa.array(part))
        for first in range(0, len(rows), QUERY_ROWS):
            row = rows[first : first + QUERY_ROWS]
            query, score, place = _best_of_scores(cosine(queries[row], held), held_ids, best.k)
            best.add_rows(row[query], score, held_ids.take(pa.array(place)))


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    return np.einsum("ij,ij->i", vectors, vectors)


def _usual(vectors: np.ndarray) -> np.ndarray:
    return (_lengths(vectors) > 1e-60) & (_lengths(vectors) < 1e60)


def _units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt(_lengths(vectors))[:, None]).astype(np.float32)


def _pair_cosines(queries: np.ndarray, vectors: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cosine, as ``cosine`` gives it, of row ``query[i]`` and row ``at[i]``."""
    products = [
        np.einsum("ij,ij->i", queries[query[i : i + PAIR_ROWS]], vectors[at[i : i + PAIR_ROWS]])
        for i in range(0, len(query), PAIR_ROWS)
    ]
    lengths = _lengths(queries)[query] * _lengths(vectors)[at]
    return np.round(np.concatenate([np.empty(0), *products]) / np.sqrt(lengths), 6) + 0.0


def _best_of_usual(
    queries: np.ndarray, vectors: np.ndarray, units: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of each query among ``vectors``, which are in the order that breaks ties:
    query, score, row of the vector; sorted by query, best first."""
    n, dim = queries.shape
    error = 2e-6 + dim * 1.2e-7  # of rounding to 6 decimals and of a sum in single precision
    asked, bar = _units(queries), np.full(n, -np.inf)
    query, score, place = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    for start in range(0, len(vectors), VECTOR_ROWS):
        held = vectors[start : start + VECTOR_ROWS]
        near = asked @ units[start : start + VECTOR_ROWS].T
        width = near.shape[1]
        if start == 0 and width > k:
            bar = np.partition(near, width - k, axis=1)[:, width - k].astype(np.float64) - error
        pair = np.flatnonzero(near >= (bar - error).astype(np.float32)[:, None])
        row, at = pair // width, pair % width
        if len(pair) <= MOST_PAIRS:
            found = _pair_cosines(queries, held, row, at)
        else:
            row, found, at = _best_of_scores(cosine(queries, held), pa.table({"place": np.arange(width)}), k)
        query, score, place = (
            np.concatenate(both) for both in ((query, row), (score, found), (place, at + start))
        )
        kept = _cut(query, score, place, k)
        query, score, place = query[kept], score[kept], place[kept]
        ends = np.cumsum(np.bincount(query, minlength=n))
        full = np.diff(ends, prepend=0) == k
        bar = np.full(n, -np.inf)
        bar[full] = score[ends[full] - 1]
    return query, score, place


DOCUMENT_ROWS = 512


def bm25_block(
    best: TopK,
    queries: pa.Table,
    documents: pa.Table,
    ids: list[str],
    average_length: float,
    k1: float,
    b: float,
) -> None:
    """Score a block of documents by BM25.

    ``queries`` holds terms and weights (the idf of each term), ``documents``
    terms, tfs and doc_len. Only terms of the queries get a column; a document
    that shares no term with a query has no score.
    """
    for at in range(0, queries.num_rows, QUERY_ROWS):
        asked = queries.slice(at, QUERY_ROWS)
        asked_terms = asked.column("terms").combine_chunks()
        vocabulary = pc.unique(asked_terms.flatten())
        weights = np.zeros((asked.num_rows, len(vocabulary)))
        weights[
            _parents(asked_terms), pc.index_in(asked_terms.flatten(), vocabulary).to_numpy()
        ] = asked.column("weights").combine_chunks().flatten().to_numpy()
        for start in range(0, documents.num_rows, DOCUMENT_ROWS):
            held = documents.slice(start, DOCUMENT_ROWS)
            terms = held.column("terms").combine_chunks()
            column = pc.index_in(terms.flatten(), vocabulary)
            known = pc.is_valid(column).to_numpy(zero_copy_only=False)
            row = _parents(terms)[known]
            length = held.column("doc_len").to_numpy().astype(np.float64)
            tf = held.column("tfs").combine_chunks().flatten().to_numpy()[known].astype(np.float64)
            saturated = np.zeros((held.num_rows, len(vocabulary)))
            saturated[row, column.drop_null().to_numpy()] = (
                tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average_length))
            )
            scores = weights @ saturated.T
            best.add(at, np.where(scores > 0, np.round(scores, 6), np.nan), held.select(ids))


def _parents(lists: pa.ListArray) -> np.ndarray:
    """For each value of a list column, the row it belongs to."""
    return pc.list_parent_indices(lists).to_numpy()
