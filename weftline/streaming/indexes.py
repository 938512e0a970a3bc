"""Chunk index, its vectors and point table kept current from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import indexing
from weftline.operators.search import chunk_vectors
from weftline.sources.versions import VersionStore

CHUNKS, STATE, POINTS, VECTORS = "chunks", "state", "points", "vectors"


def rebuild_indexes(store: VersionStore, documents: DataFrame) -> None:
    """Make all four tables anew from the whole corpus, whatever the store holds, and
    publish them in one step."""
    chunks = store.write(indexing.full_rebuild(documents), CHUNKS)
    store.publish(
        {
            CHUNKS: chunks,
            VECTORS: store.write(chunk_vectors(store.read(chunks)), VECTORS),
            STATE: store.write(indexing.index_state(documents), STATE),
            POINTS: store.write(indexing.point_index(documents), POINTS),
        }
    )


def update_indexes(store: VersionStore, documents: DataFrame, complete: bool) -> None:
    """Bring the published chunk index, its vectors and state and the point table up
    to date.

    ``complete`` says that ``documents`` is the whole corpus, so documents it
    lacks are deleted; a partial batch only inserts and updates. The four
    tables are published in one step, so a run that fails is simply run again.
    """
    new_state = indexing.index_state(documents)
    old_state, old_index = store.current(STATE), store.current(CHUNKS)
    old_points, old_vectors = store.current(POINTS), store.current(VECTORS)
    if old_state is None or old_index is None or old_points is None:
        rebuild_indexes(store, documents)
        return
    if old_vectors is None:  # an index published without vectors
        old_vectors = chunk_vectors(old_index)
    diff = indexing.index_diff(old_state, new_state)
    if not complete:
        diff = diff.where(F.col("change") != indexing.DELETE)
    diff = store.read(store.write(diff, "diff"))
    seen = diff.select("doc_id")
    state = new_state if complete else old_state.join(seen, "doc_id", "left_anti").unionByName(new_state)
    points = indexing.point_index(documents)
    if not complete:
        kept = old_points.join(seen.withColumnRenamed("doc_id", "point_id"), "point_id", "left_anti")
        points = kept.unionByName(points)
    chunks = store.write(indexing.index_apply(old_index, diff, documents), CHUNKS)
    vectors = indexing.vectors_apply(old_vectors, diff, store.read(chunks))
    store.publish(
        {
            CHUNKS: chunks,
            VECTORS: store.write(vectors, VECTORS),
            STATE: store.write(state, STATE),
            POINTS: store.write(points, POINTS),
        }
    )


def newest(batch: DataFrame, version: str) -> DataFrame:
    """The row of the largest ``version`` of each document, without that column."""
    order = Window.partitionBy("doc_id").orderBy(F.col(version).desc_nulls_last(), F.sha2("text", 256))
    ranked = batch.withColumn("place__", F.row_number().over(order))
    return ranked.where("place__ = 1").drop("place__", version)


def start_index_updates(
    documents: DataFrame, store: VersionStore, checkpoint: str, version: str | None = None
) -> StreamingQuery:
    """Upsert a stream of documents into both indexes, all that is available.

    A batch may be delivered again after a failure; applying it twice changes
    nothing. Of several versions in one batch the newest wins: the largest value of
    the column ``version`` or, without one, of the source file's modification time.
    The choice is stored first, so every table is derived from it. Bound the size of a batch with
    ``maxFilesPerTrigger`` on the source.
    """

    if version is None:
        version = "arrived__"
        documents = documents.withColumn(version, F.col("_metadata.file_modification_time"))

    def upsert(batch: DataFrame, _: int) -> None:
        once = store.read(store.write(newest(batch, version), "arrivals"))
        update_indexes(store, once, complete=False)

    return (
        documents.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
