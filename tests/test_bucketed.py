import pytest
from conftest import rows, same_rows
from pyspark.sql import functions as F

from weftline.operators import bucketed, health, indexing, search
from weftline.operators.bucketed import BucketedIndex
from weftline.sources.tables import load_table
from weftline.sources.versions import VersionStore
from weftline.sources.workspace import fresh_path, stage


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return stage(load_table(spark, tiny, "documents"), "docs")


def new_index(spark, n_buckets=16):
    return BucketedIndex(VersionStore(spark, fresh_path(spark, "store")), n_buckets)


def equals_rebuild(index, docs):
    chunks = indexing.full_rebuild(docs)
    same_rows(index.table(bucketed.CHUNKS), chunks)
    same_rows(index.table(bucketed.VECTORS), search.chunk_vectors(chunks))
    same_rows(index.table(bucketed.STATE), indexing.index_state(docs))
    same_rows(index.table(bucketed.POINTS), indexing.point_index(docs))
    same_rows(index.table(bucketed.POINT_VECTORS), indexing.point_vectors(docs))
    same_rows(index.chunk_health(), health.chunk_index_health(chunks))
    same_rows(index.point_health(), health.vector_index_health(indexing.point_index(docs)))


def test_updates_equal_a_rebuild(spark, docs):
    index = new_index(spark)
    assert index.table(bucketed.CHUNKS) is None
    index.update(docs.where("lang <> 'es'"), complete=True)
    equals_rebuild(index, docs.where("lang <> 'es'"))
    later = docs.where("source <> 'src3'").withColumn(
        "text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" fin."))).otherwise(F.col("text"))
    )
    index.update(later, complete=True)
    equals_rebuild(index, later)
    assert index.rebuild(docs) == list(range(16))
    equals_rebuild(index, docs)


def test_only_touched_buckets_are_read_and_written(spark, docs):
    index = new_index(spark)
    index.rebuild(docs)
    before = {t: index.versions(t) for t in bucketed.KEYS}
    changed = docs.where("doc_id IN (3, 40)").withColumn("text", F.concat("text", F.lit(" more")))
    touched = index.update(changed, complete=False)
    expected = {r[0] for r in changed.select(bucketed.bucket_of(F.col("doc_id"), 16)).collect()}
    assert set(touched) == expected and len(expected) < 16
    for table, held in before.items():
        now = index.versions(table)
        assert {b for b in held if now[b] != held[b]} == expected
    written = sum(index.table(bucketed.STATE, [b]).count() for b in touched)
    assert written < docs.count() / 4
    equals_rebuild(index, docs.where("doc_id NOT IN (3, 40)").unionByName(changed))
    assert index.update(changed, complete=False) == []


def test_deletions_of_a_batch(spark, docs):
    index = new_index(spark)
    index.update(docs, complete=True)
    gone = spark.createDataFrame([(5,), (6,), (5,), (10**9,)], "doc_id bigint")
    index.update(docs.where("doc_id = 6"), complete=False, deleted=gone)  # 6 is brought again: it stays
    equals_rebuild(index, docs.where("doc_id <> 5"))


def test_an_emptied_bucket_and_an_empty_corpus(spark, docs):
    index = new_index(spark, 8)
    index.update(docs, complete=True)
    bucket = bucketed.bucket_of(F.col("doc_id"), 8)
    rest = docs.where(bucket != 2)
    assert index.update(rest, complete=True) == [2]
    assert 2 not in index.versions(bucketed.CHUNKS)
    equals_rebuild(index, rest)
    index.update(docs.limit(0), complete=True)
    assert index.table(bucketed.CHUNKS) is None


def test_a_reader_keeps_its_version_and_a_failed_update_publishes_nothing(spark, docs):
    index = new_index(spark)
    index.update(docs, complete=True)
    held, before = index.table(bucketed.POINTS), index.versions(bucketed.POINTS)
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception):
        index.update(broken, complete=True)
    assert index.versions(bucketed.POINTS) == before
    index.update(docs.where("lang = 'en'"), complete=True)
    same_rows(held, indexing.point_index(docs))


def test_the_number_of_buckets_is_fixed(spark, docs):
    index = new_index(spark, 4)
    assert BucketedIndex(index.store, 99).n_buckets == 4


def test_buckets_of_ids(spark):
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    found = rows(ids.select(bucketed.bucket_of(F.col("doc_id"), 7)))
    assert found[1] == found[2] and found[0] == (0,)


def test_a_large_bucket_is_written_by_several_tasks(spark, tiny):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {name: spark.conf.get(name) for name in settings}
    docs = load_table(spark, tiny, "documents").repartition(6, "doc_id")
    no_id = docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        index = bucketed.BucketedIndex(VersionStore(spark, fresh_path(spark, "store")), 1)
        index.update(docs.unionByName(no_id), complete=True)
        assert len(index.table(bucketed.CHUNKS).inputFiles()) > 2
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    equals_rebuild(index, docs)
