"""Task-side helpers over batches of tokenised texts.

Tokens are cut in the JVM and arrive as a list column, the last of the batch.
Each works on the distinct tokens of a batch and on row numbers, never on one
text at a time.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]

# A batch is counted in slices of so many tokens: the arrays made on the way take some 100
# bytes a token, however many rows, and however long ones, Spark puts into a batch.
SLICE_TOKENS = 1 << 18


def slices(batches: Batches, most: int = SLICE_TOKENS) -> Batches:
    """The rows of ``batches`` in the same order, in runs of at most ``most`` tokens; a
    longer row is a run of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0)
        ends = np.cumsum(lengths.to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def _replace_last(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = batch.schema.names[:-1]
    arrays = [*[batch.column(name) for name in kept], *columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])


def bucket_of(token: str, buckets: int) -> int:
    """First 32 bits of the token's md5, modulo ``buckets``."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % buckets


def hashed_vectors(buckets: int, name: str) -> Callable[[Batches], Batches]:
    """Feature hashing (Weinberger et al. 2009): replace the tokens by an
    L2-normalised vector of bucket counts. A token is hashed once per slice."""

    def embed(batches: Batches) -> Batches:
        for batch in slices(batches):
            rows = batch.num_rows
            tokens = batch.column(batch.num_columns - 1)
            coded = tokens.flatten().dictionary_encode()
            bucket = np.array([bucket_of(t, buckets) for t in coded.dictionary.to_pylist()], np.int64)
            row = pc.list_parent_indices(tokens).to_numpy()
            slot = row * buckets + bucket[coded.indices.to_numpy()]
            counts = np.bincount(slot, minlength=rows * buckets).reshape(rows, buckets)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            vectors = counts / np.maximum(norm, 1.0)  # only a zero vector has a norm below 1
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * buckets)
            values = pa.array(vectors.ravel())
            yield _replace_last(batch, {name: pa.ListArray.from_arrays(offsets, values)})

    return embed


def count_terms(batches: Batches) -> Batches:
    """Replace the tokens by the distinct terms and their counts, two lists of
    equal length."""
    for batch in slices(batches):
        tokens = batch.column(batch.num_columns - 1)
        coded = tokens.flatten().dictionary_encode()
        kinds = max(len(coded.dictionary), 1)
        row = pc.list_parent_indices(tokens).to_numpy()
        pair, times = np.unique(
            row.astype(np.int64) * kinds + coded.indices.to_numpy(), return_counts=True
        )
        offsets = pa.array(
            np.searchsorted(pair // kinds, np.arange(batch.num_rows + 1)).astype(np.int32)
        )
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pair % kinds)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
        yield _replace_last(batch, {"terms": terms, "tfs": tfs})
