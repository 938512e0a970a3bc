"""Upkeep of the chunk index and the point table: difference, apply, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators.chunking import chunk_documents
from weftline.operators.embedding import hashed_embedding
from weftline.operators.search import chunk_vectors
from weftline.plans.sizing import broadcast_if_small

INSERT, UPDATE, DELETE, UNCHANGED = "insert", "update", "delete", "unchanged"


def index_state(documents: DataFrame) -> DataFrame:
    """What an index of ``documents`` has seen: doc_id, content_hash. The layer
    is part of the hash because it is part of the chunks; JSON keeps nulls and the
    two columns apart."""
    seen = F.to_json(F.struct("lang", "text"))
    return documents.select("doc_id", tx.content_hash(seen).alias("content_hash"))


def index_diff(old_state: DataFrame, new_state: DataFrame) -> DataFrame:
    """doc_id and change for every document in either state. Only ids and hashes
    are shuffled."""
    old = old_state.select("doc_id", F.col("content_hash").alias("old_hash"))
    new = new_state.select("doc_id", F.col("content_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), INSERT)
        .when(F.col("new_hash").isNull(), DELETE)
        .when(F.col("old_hash") != F.col("new_hash"), UPDATE)
        .otherwise(UNCHANGED)
    )
    return old.join(new, "doc_id", "full_outer").select("doc_id", change.alias("change"))


def index_apply(old_index: DataFrame, diff: DataFrame, new_documents: DataFrame) -> DataFrame:
    """The old chunks of untouched documents and fresh chunks of new and changed
    ones. ``diff`` is used three times: pass a stored table.

    While the changed ids are few they are broadcast, and neither the index nor
    the documents move.
    """
    gone = broadcast_if_small(diff.where(F.col("change").isin(UPDATE, DELETE)).select("doc_id"))
    fresh = broadcast_if_small(diff.where(F.col("change").isin(INSERT, UPDATE)).select("doc_id"))
    kept = old_index.join(gone, "doc_id", "left_anti")
    added = chunk_documents(new_documents.join(fresh, "doc_id", "left_semi"))
    return kept.unionByName(added)


def vectors_apply(old_vectors: DataFrame, diff: DataFrame, new_index: DataFrame) -> DataFrame:
    """The old vectors of untouched documents and those of the fresh chunks in
    ``new_index``, the chunk index after the same ``diff``."""
    gone = broadcast_if_small(diff.where(F.col("change").isin(UPDATE, DELETE)).select("doc_id"))
    fresh = broadcast_if_small(diff.where(F.col("change").isin(INSERT, UPDATE)).select("doc_id"))
    kept = old_vectors.join(gone, "doc_id", "left_anti").select(old_vectors.columns)
    return kept.unionByName(chunk_vectors(new_index.join(fresh, "doc_id", "left_semi")))


def full_rebuild(documents: DataFrame) -> DataFrame:
    """The chunk index from nothing. Equal to applying any chain of differences
    that ends at ``documents``."""
    return chunk_documents(documents)


def point_index(documents: DataFrame) -> DataFrame:
    """One point per document: point_id, layer, summary."""
    return documents.select(
        F.col("doc_id").alias("point_id"),
        F.col("lang").alias("layer"),
        tx.summary(F.col("text")).alias("summary"),
    )


def point_vectors(documents: DataFrame) -> DataFrame:
    """Sparse vectors of the points: point_id, bucket, weight."""
    return hashed_embedding(documents.select(F.col("doc_id").alias("point_id"), "text"), "point_id")
