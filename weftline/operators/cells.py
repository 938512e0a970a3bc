"""A vector index stored by cell: a search reads the cells it probes and no others.

The vectors lie in one folder per cell. The cells of all queries are known before the
index is opened, at most one number per cell, so they become a filter on the folders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import search
from weftline.sources.versions import VersionStore
from weftline.sources.workspace import stage

CELLS, CENTRES = "cells", "centres"
MAX_CELLS = 16_384


def cells_for(n_vectors: int) -> int:
    """How many cells: about the square root of the vectors, so that finding the cells
    and reading one cost about the same."""
    return max(1, min(MAX_CELLS, round(math.sqrt(max(n_vectors, 0)))))


def publish_cells(store: VersionStore, vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id") -> None:
    """Assign every vector to its nearest cell and publish cells and centres together.
    A large cell is written as several files by several tasks."""
    celled = search.ivf_index(vectors.select(id_col, "embedding"), centroids, id_col)
    held = store.write(celled.hint("rebalance", "cell"), CELLS, partition_by="cell")
    store.publish({CELLS: held, CENTRES: store.write(centroids.select("cell", "embedding"), CENTRES)})


def publish_kmeans_cells(store: VersionStore, vectors: DataFrame, n_cells: int | None = None, id_col: str = "vec_id") -> None:
    """Learn the cells, as many as the table asks for, and publish."""
    n_cells = n_cells or cells_for(vectors.count())
    publish_cells(store, vectors, search.kmeans_centroids(vectors, n_cells), id_col)


def probed_cells(store: VersionStore, queries: DataFrame, n_probe: int) -> list[int]:
    """The cells nearest to any query, in order."""
    asked = queries.select("query_id", "embedding")
    routes = search.nearest_cells(asked, store.current(CENTRES), n_probe, "query_id")
    return sorted(row["cell"] for row in routes.select("cell").distinct().collect())


def search_cells(
    store: VersionStore, queries: DataFrame, k: int, n_probe: int, exclude_self: bool = False
) -> DataFrame:
    """k nearest vectors among the ``n_probe`` cells nearest to each query: query_id,
    id, sim, rank. ``queries`` holds query_id and embedding; it is read twice: pass a
    stored table if making it is dear."""
    cells = probed_cells(store, queries, n_probe)
    held = store.current(CELLS).where(F.col("cell").isin(cells))
    return search.cosine_topk_ivf(queries, held, store.current(CENTRES), k, n_probe, exclude_self)


def recall(found: DataFrame, exact: DataFrame, k: int) -> float:
    """Share of the exact k nearest that were found, over all queries."""
    exact = stage(exact.select("query_id", "vec_id"), "exact")
    hits = found.select("query_id", "vec_id").join(exact, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(exact.count(), 1)
