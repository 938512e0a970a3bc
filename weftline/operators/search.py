"""Cosine nearest neighbours, exact and by cells.

No plan here emits candidate pairs: a task scores a block of vectors against a
block of queries and passes on at most k rows per query. Which blocks meet is
decided in Spark:

- few queries (counted first): they travel with the task, vectors stay where
  they are, nothing is shuffled but the k best per partition;
- many queries: both sides are cut into slices by the hash of the id, and each
  pair of slices is one group of a cogroup. Slices are cut so that no group
  exceeds a fixed size, however large one cell is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import topk
from weftline.functions.vectors import unit
from weftline.operators.chunking import chunk_documents
from weftline.operators.embedding import embed
from weftline.plans import sizing

MAX_TRAVELLING_ROWS = 20_000
MAX_GROUPS = 100_000
SLICE_CANDIDATES = 100_000
SLICE_QUERIES = 50_000
ROUTE = "route__"

# Scores a block of candidates against a block of queries into a TopK.
Scorer = Callable[[topk.TopK, pa.Table, pa.Table], None]


def cosine_scorer(ids: list[str]) -> Scorer:
    def score(best: topk.TopK, queries: pa.Table, candidates: pa.Table) -> None:
        topk.cosine_block(
            best,
            topk.matrix(queries.column("embedding")),
            topk.matrix(candidates.column("embedding")),
            candidates.select(ids),
        )

    return score


def best_matches(
    queries: DataFrame,
    candidates: DataFrame,
    ids: list[str],
    k: int,
    scorer: Scorer,
    score: str,
    max_travelling: int = MAX_TRAVELLING_ROWS,
    slice_candidates: int | None = None,
) -> DataFrame:
    """The best k candidates per query and task, over all candidates: query_id,
    ids, score. ``ids[0]`` breaks ties. Picks the plan by the number of queries;
    ``ranked`` makes the final cut."""
    schema = _schema(queries, candidates, ids, score)
    small = sizing.fetch_bounded(queries, max_travelling)
    if small is not None:
        best = with_travelling_queries(small, candidates, k, scorer, schema)
    else:
        best = in_slices(
            queries.withColumn(ROUTE, F.lit(0)),
            candidates.withColumn(ROUTE, F.lit(0)),
            k,
            scorer,
            schema,
            slice_candidates,
        )
    return best


def ranked(best: DataFrame, id_col: str, k: int, score: str = "sim") -> DataFrame:
    """Final cut over the k best of every task. The row_number filter also runs
    before the shuffle, as a group limit."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), F.col(id_col))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _schema(queries: DataFrame, candidates: DataFrame, ids: list[str], score: str) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields += [T.StructField(c, candidates.schema[c].dataType) for c in ids]
    return T.StructType([*fields, T.StructField(score, T.DoubleType())])


def with_travelling_queries(
    small: pa.Table, candidates: DataFrame, k: int, scorer: Scorer, schema: T.StructType
) -> DataFrame:
    """Every partition of candidates keeps its k best per query."""
    score = schema.fields[-1].name

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = topk.TopK(k)
        for batch in batches:
            if batch.num_rows and small.num_rows:
                scorer(best, small, pa.Table.from_batches([batch]))
        found = best.table(small.column("query_id"), "query_id", score)
        if found is not None:
            yield from found.to_batches()

    return candidates.mapInArrow(best_of_partition, schema)


def in_slices(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    scorer: Scorer,
    schema: T.StructType,
    slice_candidates: int | None = None,
) -> DataFrame:
    """Best k per query among the candidates that share its route.

    ``queries`` has one row per query and route, ``candidates`` one per
    candidate. A route is cut into slices on both sides; each pair of slices is
    one group, so a hot cell becomes many groups of bounded size.
    """
    names = [f.name for f in schema.fields]
    ids, score = names[1:-1], names[-1]
    slices = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    shapes = (
        candidates.groupBy(ROUTE)
        .agg(F.count(F.lit(1)).alias("n_candidates"))
        .join(queries.groupBy(ROUTE).agg(F.count(F.lit(1)).alias("n_queries")), ROUTE)
        .select(
            ROUTE,
            slices("n_candidates", slice_candidates or SLICE_CANDIDATES).alias("c_slices"),
            slices("n_queries", SLICE_QUERIES).alias("q_slices"),
        )
    )
    known = sizing.fetch_bounded(shapes, MAX_GROUPS)
    if known is not None:
        shapes = F.broadcast(candidates.sparkSession.createDataFrame(known, shapes.schema))
    slot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    counts = ["c_slices", "q_slices"]
    sliced_candidates = (
        candidates.join(shapes, ROUTE)
        .withColumn("c_slice", slot(ids[0], "c_slices"))
        .withColumn("q_slice", every("q_slices"))
        .drop(*counts)
    )
    sliced_queries = (
        queries.join(shapes, ROUTE)
        .withColumn("q_slice", slot("query_id", "q_slices"))
        .withColumn("c_slice", every("c_slices"))
        .drop(*counts)
    )
    # Queries and candidates may be the same table: give one side its own columns.
    sliced_queries = sliced_queries.select(*[F.col(c).alias(c) for c in sliced_queries.columns])

    def best_of_group(held: pa.Table, asked: pa.Table) -> pa.Table:
        best = topk.TopK(k)
        if held.num_rows and asked.num_rows:
            scorer(best, asked, held)
        found = best.table(asked.column("query_id"), "query_id", score)
        if found is not None:
            return found
        kinds = {"query_id": asked.schema.field("query_id").type, score: pa.float64()}
        kinds.update({c: held.schema.field(c).type for c in ids})
        return pa.table({c: pa.array([], type=kinds[c]) for c in names})

    keys = [ROUTE, "c_slice", "q_slice"]
    return (
        sliced_candidates.groupBy(*keys)
        .cogroup(sliced_queries.groupBy(*keys))
        .applyInArrow(best_of_group, schema)
    )


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    exclude_self: bool = False,
    max_travelling: int = MAX_TRAVELLING_ROWS,
) -> DataFrame:
    """Exact k nearest vectors of each query: query_id, ids, sim, rank.

    ``queries`` holds query_id and embedding; ``vectors`` an id column, any
    further columns to carry along, and embedding. ``exclude_self`` drops the
    vector whose id equals the query's.
    """
    ids = [c for c in vectors.columns if c != "embedding"]
    asked = queries.select("query_id", "embedding")
    keep = k + 1 if exclude_self else k
    best = best_matches(asked, vectors, ids, keep, cosine_scorer(ids), "sim", max_travelling)
    if exclude_self:
        best = best.where(F.col(ids[0]) != F.col("query_id"))
    return ranked(best, ids[0], k)


# --- cells -----------------------------------------------------------------


def label_centroids(vectors: DataFrame, dim: int) -> DataFrame:
    """Mean vector per label, L2-normalised, 6 decimals: cell, embedding."""
    means = vectors.groupBy(F.col("label").alias("cell")).agg(
        *[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)]
    )
    mean = F.array(*[F.col(f"m{i}") for i in range(dim)])
    centre = unit(F.col("mean"))
    return means.select("cell", mean.alias("mean")).select(
        "cell", F.transform(centre, lambda x: F.round(x, 6)).alias("embedding")
    )


def kmeans_centroids(vectors: DataFrame, cells: int, seed: int = 7, max_iter: int = 10) -> DataFrame:
    """Centroids by distributed k-means over unit vectors: cell, embedding."""
    points = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(
        k=cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine", initMode="k-means||"
    ).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, embedding array<double>")


def nearest_cells(
    vectors: DataFrame,
    centroids: DataFrame,
    n: int = 1,
    id_col: str = "vec_id",
    max_travelling: int = MAX_TRAVELLING_ROWS,
) -> DataFrame:
    """The n nearest cells of every vector: the columns of ``vectors`` and cell.

    Ties go to the lower cell. Centroids are few (counted first) and travel with
    the task, so no row of ``vectors`` is shuffled.
    """
    centres = centroids.select("cell", "embedding")
    small = sizing.fetch_bounded(centres, max_travelling)
    if small is None:
        points = vectors.select(F.col(id_col).alias("query_id"), "embedding")
        found = cosine_topk(points, centres, n, max_travelling=0)
        return vectors.join(found.select(F.col("query_id").alias(id_col), "cell"), id_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centre = small.select(["cell"]), topk.matrix(small.column("embedding"))
        for batch in batches:
            if batch.num_rows and cells.num_rows:
                best = topk.TopK(n)
                topk.cosine_block(best, topk.matrix(batch.column("embedding")), centre, cells)
                chosen = best.table(pa.array(range(batch.num_rows)), "at", "sim")
                rows = pa.Table.from_batches([batch]).take(chosen.column("at"))
                yield from rows.append_column("cell", chosen.column("cell")).to_batches()

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", centroids.schema["cell"].dataType)])
    return vectors.mapInArrow(assign, schema)


def ivf_index(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Coarse quantiser (Jegou et al. 2011): every vector with its nearest cell.
    Store the result; it is the index."""
    return nearest_cells(vectors, centroids, 1, id_col)


def ivf_cells(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """id_col and cell of every vector."""
    return ivf_index(vectors.select(id_col, "embedding"), centroids, id_col).select(id_col, "cell")


def cosine_topk_ivf(
    queries: DataFrame,
    celled: DataFrame,
    centroids: DataFrame,
    k: int,
    nprobe: int,
    exclude_self: bool = False,
) -> DataFrame:
    """k nearest among the vectors of the ``nprobe`` cells nearest to the query.

    ``celled`` is the stored index: an id column, cell and embedding. Exact when
    ``nprobe`` is the number of cells.
    """
    ids = [c for c in celled.columns if c not in ("embedding", "cell")]
    routed = nearest_cells(
        queries.select("query_id", "embedding"), centroids, nprobe, "query_id"
    ).withColumnRenamed("cell", ROUTE)
    schema = _schema(queries, celled, ids, "sim")
    keep = k + 1 if exclude_self else k
    held = celled.select(F.col("cell").alias(ROUTE), *ids, "embedding")
    best = in_slices(routed, held, keep, cosine_scorer(ids), schema)
    if exclude_self:
        best = best.where(F.col(ids[0]) != F.col("query_id"))
    return ranked(best, ids[0], k)


# --- text ------------------------------------------------------------------


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """What a search reads of the chunk index: chunk_id, doc_id, embedding."""
    return embed(chunks.select("chunk_id", "doc_id", "text"))


def search_chunks(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Chunks nearest to each query text, from stored ``chunk_vectors``; no text of
    the corpus is read.

    ``queries`` holds item_id and text. Result: item_id, chunk_id, doc_id, sim, rank.
    """
    asked = embed(queries.select(F.col("item_id").alias("query_id"), "text"))
    return cosine_topk(asked, vectors, k).withColumnRenamed("query_id", "item_id")


def semantic_search(queries: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """Chunks of ``documents`` nearest to each query text, without a stored index.

    Chunking, embedding and scoring are one stage over the documents.
    """
    return search_chunks(queries, chunk_vectors(chunk_documents(documents)), k)
