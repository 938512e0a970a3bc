"""Chunks, vectors, points and state of an index, in hash buckets of the document id.

A bucket of a table is a published version of its own. An update compares ids and
hashes, then reads and writes only the buckets that hold a changed document, and
publishes these buckets of all tables in one step. Its cost follows the change, not
the corpus: texts are read for changed documents only, all other rows of a touched
bucket are copied as they are.

Counts per layer are kept with each bucket, so health reports read neither texts nor
chunks: counts of buckets add up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import health, indexing
from weftline.operators.chunking import chunk_documents
from weftline.operators.indexing import DELETE, INSERT, UNCHANGED, UPDATE
from weftline.operators.search import chunk_vectors
from weftline.plans.sizing import broadcast_if_small
from weftline.sources.versions import Version, VersionStore
from weftline.sources.workspace import side_by_side, stage, subfolders

BUCKETS = 16
BUCKET = "bucket__"
LAYOUT = "layout"
CHUNKS, VECTORS, STATE, POINTS, POINT_VECTORS = "chunks", "vectors", "state", "points", "point-vectors"
CHUNK_LAYERS, POINT_LAYERS = "chunk-layers", "point-layers"
KEYS = {CHUNKS: "doc_id", VECTORS: "doc_id", STATE: "doc_id", POINTS: "point_id", POINT_VECTORS: "point_id"}


def bucket_of(key: Column, n_buckets: int) -> Column:
    """Bucket of an id, the first 32 bits of its md5 modulo the number of buckets; a
    row without an id is in bucket 0."""
    digest = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(digest % n_buckets, F.lit(0)).cast("int")


def _entry(table: str, bucket: int) -> str:
    return f"{table}/{bucket:06d}"


class BucketedIndex:
    """The tables of one index in a version store.

    Choose so many buckets that one holds some hundred MB of text, since an update copies
    whole buckets. A large bucket of a table is written by several tasks. The number is
    fixed when the index is first used.
    """

    def __init__(self, store: VersionStore, n_buckets: int = BUCKETS) -> None:
        self.store, self.spark = store, store.spark
        held = store.current(LAYOUT)
        if held is None:
            held = store.replace(LAYOUT, self.spark.range(1).select(F.lit(n_buckets).alias("buckets")))
        self.n_buckets = held.first()["buckets"]

    # --- reading ---

    def versions(self, table: str) -> dict[int, Version]:
        """The published buckets of a table; an empty bucket has none."""
        return {int(name.rpartition("/")[2]): v for name, v in self.store.versions(f"{table}/").items()}

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets, in one scan. None when nothing is held."""
        wanted = None if buckets is None else set(buckets)
        return self._read([v for b, v in sorted(self.versions(name).items()) if wanted is None or b in wanted])

    def _read(self, held: list[Version]) -> DataFrame | None:
        return self.spark.read.schema(held[0].schema).parquet(*[v.path for v in held]) if held else None

    def chunk_health(self) -> DataFrame:
        """layer, n_chunks, share, symbol_coverage, from the counts kept with the buckets."""
        return health.layer_report(self.table(CHUNK_LAYERS), "n_chunks", "symbol_coverage")

    def point_health(self) -> DataFrame:
        """layer, n_points, share, summary_coverage, from the counts kept with the buckets."""
        return health.layer_report(self.table(POINT_LAYERS), "n_points", "summary_coverage")

    # --- writing ---

    def rebuild(self, documents: DataFrame) -> list[int]:
        """All buckets anew from the whole corpus, whatever the index holds."""
        every = list(range(self.n_buckets))
        self._write(documents, None, every)
        return every

    def update(self, documents: DataFrame, complete: bool, deleted: DataFrame | None = None) -> list[int]:
        """Bring the index up to date; the buckets it wrote.

        ``complete`` says that ``documents`` is the whole corpus, so documents it
        lacks are deleted. A partial batch inserts and updates, and deletes the ids
        (doc_id) in ``deleted`` that the batch does not bring.
        """
        state = indexing.index_state(documents)
        ids = state.select("doc_id") if deleted is None else state.select("doc_id").unionByName(deleted.select("doc_id"))
        held = self.table(STATE, None if complete else self._buckets_of(ids))
        diff = indexing.index_diff(state.limit(0) if held is None else held, state)
        if not complete:
            gone = F.col("change") == DELETE
            kept = diff.where(~gone)
            if deleted is not None:
                kept = kept.unionByName(diff.where(gone).join(deleted.select("doc_id").distinct(), "doc_id", "left_semi"))
            diff = kept
        changed = diff.where(F.col("change") != UNCHANGED).withColumn(BUCKET, bucket_of(F.col("doc_id"), self.n_buckets))
        changed = stage(changed, "changes")
        touched = sorted(row[0] for row in changed.select(BUCKET).distinct().collect())
        if touched:
            self._write(documents, changed, touched, all_new=held is None)
        return touched

    def _buckets_of(self, ids: DataFrame) -> list[int]:
        found = ids.select(bucket_of(F.col("doc_id"), self.n_buckets).alias(BUCKET)).distinct()
        return [row[0] for row in found.collect()]

    def _write(
        self, documents: DataFrame, changed: DataFrame | None, touched: list[int], all_new: bool = False
    ) -> None:
        """Write the touched buckets of every table side by side and publish them
        together. ``changed`` None replaces everything. ``all_new`` says that every
        document that has an id is an insert, so none is looked up."""
        published = self.store.versions("")
        entries: dict[str, Version] = {}
        if changed is None:
            fresh_docs, gone = documents, None
        else:
            ids = lambda *kinds: changed.where(F.col("change").isin(*kinds)).select("doc_id")
            gone = broadcast_if_small(ids(UPDATE, DELETE))
            if all_new:
                fresh_docs = documents.where(F.col("doc_id").isNotNull())
            else:
                fresh_docs = documents.join(broadcast_if_small(ids(INSERT, UPDATE)), "doc_id", "left_semi")
            fresh_docs = stage(fresh_docs, "fresh")

        def put(name: str, fresh: DataFrame) -> DataFrame:
            key, rows = KEYS[name], fresh
            names = [_entry(name, b) for b in touched]
            held = None if gone is None else self._read([published[n] for n in names if n in published])
            if held is not None:
                left = gone.select(F.col("doc_id").alias(key))
                rows = held.join(left, key, "left_anti").select(fresh.columns).unionByName(fresh)
            return self._put(name, rows.withColumn(BUCKET, bucket_of(F.col(key), self.n_buckets)), entries)

        if changed is None:  # the chunks are many: read them back instead of cutting twice
            chunks = put(CHUNKS, chunk_documents(fresh_docs))
            fresh_chunks = chunks.drop(BUCKET)
        else:
            fresh_chunks = stage(chunk_documents(fresh_docs), "fresh-chunks")
        jobs = {
            VECTORS: lambda: put(VECTORS, chunk_vectors(fresh_chunks)),
            STATE: lambda: put(STATE, indexing.index_state(fresh_docs)),
            POINTS: lambda: put(POINTS, indexing.point_index(fresh_docs)),
            POINT_VECTORS: lambda: put(POINT_VECTORS, indexing.point_vectors(fresh_docs)),
        }
        if changed is not None:
            jobs[CHUNKS] = lambda: put(CHUNKS, fresh_chunks)
        written = dict(zip(jobs, side_by_side(self.spark, list(jobs.values())), strict=True))
        chunks, points = written.get(CHUNKS, None if changed is not None else chunks), written[POINTS]
        layers = [
            lambda: self._put(CHUNK_LAYERS, health.layer_counts(chunks, "symbol", BUCKET), entries),
            lambda: self._put(POINT_LAYERS, health.layer_counts(points, "summary", BUCKET), entries),
        ]
        side_by_side(self.spark, layers)
        touched_names = {_entry(name, b) for name in (*KEYS, CHUNK_LAYERS, POINT_LAYERS) for b in touched}
        self.store.publish(entries, withdraw=sorted((touched_names & set(published)) - set(entries)))

    def _put(self, name: str, rows: DataFrame, entries: dict[str, Version]) -> DataFrame:
        """Write the buckets of a table, each one a version to publish. Spark cuts a large
        bucket into several tasks and puts small ones together."""
        path = f"{self.store.root}/{name}/{uuid.uuid4().hex}"
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        schema = rows.drop(BUCKET).schema
        for folder in subfolders(self.spark, path):
            entries[_entry(name, int(folder.rpartition("=")[2]))] = Version(f"{path}/{folder}", schema)
        return self.spark.read.schema(rows.select(*schema.names, BUCKET).schema).parquet(path)
