"""Task-side helpers over posting blocks: the blocks of a range of documents, and the
scores that a range gives to queries. Each works on one range at a time."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS_AT_ONCE = 1_000_000


def block_schema(doc_id: str) -> str:
    return f"term string, range int, most double, n bigint, doc_ids array<{doc_id}>, weights array<double>"


def score_schema(item_id: str, doc_id: str) -> str:
    return f"item_id {item_id}, doc_id {doc_id}, score double"


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def _by_id(ids: pa.Array) -> np.ndarray:
    """The place of each id among the different ids in order, null first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1


def blocks_of_range(average: float, k1: float, b: float) -> Callable[[pa.Table], pa.Table]:
    """The documents of a range (range, doc_id, doc_len, terms, tfs) as one block a term,
    in the order of terms; in a block by id and weight. ``terms`` is a text, one space
    between two terms."""

    def run(held: pa.Table) -> pa.Table:
        terms, ids = pc.split_pattern(_column(held, "terms"), " "), _column(held, "doc_id")
        row = pc.list_parent_indices(terms).to_numpy()
        coded = terms.flatten().dictionary_encode()
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_term), np.int64)
        place[by_term] = np.arange(len(by_term))
        term = place[coded.indices.to_numpy()]
        tf = _column(held, "tfs").flatten().to_numpy().astype(np.float64)
        length = _column(held, "doc_len").to_numpy(zero_copy_only=False).astype(np.float64)[row]
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
        order = np.lexsort((weight, _by_id(ids)[row], term))
        term, row, weight = term[order], row[order], weight[order]
        starts = _starts(term)
        offsets = pa.array(np.append(starts, len(term)), pa.int32())
        n = np.diff(np.append(starts, len(term)))
        columns = {
            "term": coded.dictionary.take(pa.array(by_term[term[starts]])),
            "range": pa.array(np.full(len(starts), held.column("range")[0].as_py()), pa.int32()),
            "most": pa.array(np.maximum.reduceat(weight, starts) if len(starts) else np.empty(0)),
            "n": pa.array(n, pa.int64()),
            "doc_ids": pa.ListArray.from_arrays(offsets, ids.take(pa.array(row))),
            "weights": pa.ListArray.from_arrays(offsets, pa.array(weight)),
        }
        return pa.table(columns)

    return run


def _expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def scores_of_range(k: int | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The blocks of a range against the queries that want it (item_id, terms, idfs and
    bar): item_id, doc_id, score. With ``k`` at most the k best of each query, rounded to
    6 decimals, and none below its bar; else all sums as they are."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        items = _column(asked, "item_id")
        if not held.num_rows or not asked.num_rows:
            kinds = {"item_id": items.type, "doc_id": held.schema.field("doc_ids").type.value_type, "score": pa.float64()}
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        lists, terms = _column(held, "doc_ids"), _column(asked, "terms")
        ids = lists.flatten()
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        start, weight, doc = np.cumsum(size) - size, _column(held, "weights").flatten().to_numpy(), _by_id(ids)
        n_docs = int(doc.max()) + 1
        one = np.empty(n_docs, np.int64)
        one[doc] = np.arange(len(doc))
        block = pc.index_in(terms.flatten(), _column(held, "term"))
        known = pc.is_valid(block).to_numpy(zero_copy_only=False)
        block = block.drop_null().to_numpy()
        query, idf = pc.list_parent_indices(terms).to_numpy()[known], _column(asked, "idfs").flatten().to_numpy()[known]
        bar = pc.fill_null(_column(asked, "bar"), -np.inf).to_numpy(zero_copy_only=False)
        work = np.cumsum(np.bincount(query, size[block], len(items)) + n_docs)
        first = 0
        while first < len(items):
            before = work[first - 1] if first else 0
            last = max(int(np.searchsorted(work, before + PAIRS_AT_ONCE, side="right")), first + 1)
            own = slice(*np.searchsorted(query, [first, last]))
            at, times = _expanded(start[block[own]], size[block[own]]), size[block[own]]
            slot = np.repeat(query[own] - first, times) * n_docs + doc[at]
            sums = np.bincount(slot, np.repeat(idf[own], times) * weight[at], (last - first) * n_docs)
            sums = sums.reshape(last - first, n_docs)
            scores = np.round(sums, 6) if k else sums
            row, column = np.nonzero((sums > 0) & (scores >= bar[first:last, None]))
            score = scores[row, column]
            if k:
                order = np.lexsort((column, -score, row))
                order = order[np.arange(len(order)) - np.searchsorted(row, row[order], side="left") < k]
                row, column, score = row[order], column[order], score[order]
            found.append((row + first, one[column], score))
            first = last
        row, at, score = (np.concatenate(part) for part in zip(*found, strict=True))
        return pa.table({"item_id": items.take(pa.array(row)), "doc_id": ids.take(pa.array(at)), "score": pa.array(score)})

    return run
